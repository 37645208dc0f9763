"""The orphan tracker fed by streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marginalia.operators.orphans import PARENTS, REFS, OrphanTracker


def follow(tracker: OrphanTracker, refs: DataFrame | None, parents: DataFrame | None, checkpoint: str) -> None:
    """Take in what has arrived on two streams (in the forms REFS and PARENTS), each batch as a step, then stop.

    A batch that is delivered again after a failure changes nothing: references and parents are kept by their keys."""
    none = {ddl: tracker.spark.createDataFrame([], ddl) for ddl in (REFS, PARENTS)}

    def run(stream: DataFrame, name: str, step) -> None:
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()

    if parents is not None:
        run(parents, "parents", lambda batch, n: tracker.step(none[REFS], batch, count=True) and None)
    if refs is not None:
        run(refs, "refs", lambda batch, n: tracker.step(batch, none[PARENTS], count=True) and None)
