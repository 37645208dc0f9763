"""References to records that do not exist.

The state is kept by key and grows step by step. A step brings new references and new or changed parents:
new references probe the parents of their keys, arriving parents resolve the references that wait for them, and a
parent whose life turns out to end earlier than known reopens the references that it had resolved for later times.

A state is a list of logs in the shared folder, each written once by one step: versions of parents, and references
with their standing (``pending``; ``settled``, which has waited; ``resolved``, at once). Both are divided into buckets
by the base of their key, the same for a reference and for whatever may answer it. A step reads only the buckets
that its rows fall into and writes only rows whose standing is new; when there are more than MAX_LOGS logs they are
put together into one. A step counts once its manifest is written, so it can be repeated after the loss of an
executor or of the driver.

The result is the same for any division of the rows into steps and any order of them.

Defined results: a null or blank target is no reference; a null ``seen_at`` is live under no parent with a
bounded life; rows that differ in their arrival only are one reference, rows of one key that differ otherwise are
judged one by one; of several versions of a parent (same key and ``live_from``) the one that arrived last holds, of
those that arrived together the one that lives longest; a null ``ingested_at`` is the earliest arrival; with no rows
on either side the state is empty; other columns of the inputs are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.runtime import hadoop, hot_keys, salt_left, salt_right, scratch

REF_ID = ["src_table", "ref_field", "entity_id", "pos"]
REFS = "src_table string, ref_field string, entity_id string, pos int, space string, keys array<string>, seen_at timestamp_ntz, ingested_at timestamp_ntz"
PARENTS = "space string, key string, live_from timestamp_ntz, live_to timestamp_ntz, ingested_at timestamp_ntz"
#: Buckets of a state: by the size of what the first step brings, BUCKET_BYTES each, within bounds. Logs after which they are put together.
BUCKETS, BUCKET_BYTES, MAX_LOGS = (16, 65_536), 256 << 20, 8
#: Times as numbers. A null time of arrival is the earliest, a null end the latest.
_ENDS = "coalesce(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', live_to), 999999999999999999)"
#: What decides between versions, as one number of fixed size, so that rows are hashed and not sorted: first the arrival, then the end.
_RANK = f"cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', coalesce(ingested_at, timestamp_ntz'0001-01-01')) as decimal(38, 0)) * 1000000000000000000BD + {_ENDS}"
_VERSION = ["bucket", "space", "key", "live_from"]
_IDENTITY = [*REF_ID, "space", "keys", "seen_at"]
_INDEX_LOG = PARENTS + ", log string, bucket int"
_REFS_LOG = REFS + ", step int, standing string, log string, bucket int"
WHITE = r"(?U)^\s+|\s+$"


def trimmed(c) -> F.Column:
    return F.regexp_replace(c, WHITE, "")


def references(doc_refs: DataFrame, doc_params: DataFrame) -> DataFrame:
    """All references in the form REFS. ``space`` says among which parents the keys are sought; any key may hit."""
    kind = F.lower(F.coalesce(F.col("kind"), F.lit("symbol")))
    target = trimmed(F.col("target"))
    bare = F.when(kind == "symbol", F.regexp_replace(target, "^::", "")).otherwise(target)
    unsigned = F.when((kind == "symbol") & F.contains(bare, F.lit("(")), F.substring_index(bare, "(", 1))
    owners = [
        d.select(
            F.lit(name).alias("src_table"), F.lit("entity_id").alias("ref_field"), "entity_id", "pos", F.lit("entity").alias("space"),
            F.array("entity_id").alias("keys"), at.cast("timestamp_ntz").alias("seen_at"), "ingested_at",
        )
        for name, d, at in (("doc_refs", doc_refs, F.col("seen_at")), ("doc_params", doc_params, F.lit(None)))
    ]
    targets = doc_refs.where(target != "").select(
        F.lit("doc_refs").alias("src_table"), F.lit("target").alias("ref_field"), "entity_id", "pos", kind.alias("space"),
        F.array_compact(F.array(bare, unsigned)).alias("keys"), "seen_at", "ingested_at",
    )
    return owners[0].unionByName(owners[1]).unionByName(targets)


def parents(entities: DataFrame, symbols: DataFrame, pages: DataFrame) -> DataFrame:
    """All parents in the form PARENTS. Entities have no life span: they are there or not. Sections and anchors live as long as their page."""
    owned = entities.where(F.col("entity_id").isNotNull()).select(
        F.lit("entity").alias("space"), F.col("entity_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("live_from"), F.lit(None).cast("timestamp_ntz").alias("live_to"), "ingested_at"
    )
    life = [F.col("added_at").alias("live_from"), F.col("removed_at").alias("live_to"), "ingested_at"]
    named = symbols.where(F.col("lookup_key").isNotNull()).select(F.lit("symbol").alias("space"), F.col("lookup_key").alias("key"), *life)
    paged = pages.where(F.col("id").isNotNull()).select(F.lit("page").alias("space"), F.col("id").alias("key"), *life)
    line = r"(?m)^[^\S\r\n]*[@\\](section|anchor)[^\S\r\n]+(\S+)"
    declared = (
        pages.select(F.explode(F.regexp_extract_all("content", F.lit(line), F.lit(0))).alias("_line"), *life)
        .select(F.regexp_extract("_line", line, 1).alias("space"), F.regexp_extract("_line", line, 2).alias("key"), "live_from", "live_to", "ingested_at")
    )
    return owned.unionByName(named).unionByName(paged).unionByName(declared)


def base(space, key) -> F.Column:
    """What all keys of a reference, and all parents that may answer it, have in common: a symbol's key without parameters, else the key."""
    return F.when(space == "symbol", F.substring_index(key, "(", 1)).otherwise(key)


def _latest(versions: DataFrame, *more) -> DataFrame:
    """Each version of a parent once. Copies are combined before the shuffle."""
    return versions.groupBy(*_VERSION).agg(F.max_by("live_to", F.expr(_RANK)).alias("live_to"), F.max("ingested_at").alias("ingested_at"), *more)


@dataclass
class OrphanState:
    """Tables of a state; ``pending`` and ``resolved`` have the columns of REFS, ``index`` those of PARENTS. They can be read until ``vacuum``."""

    index: DataFrame
    pending: DataFrame
    resolved: DataFrame
    number: int = 0
    logs: list[str] = field(default_factory=list)


class OrphanTracker:
    """Pending-orphan state under ``root``, one folder for each step."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or BUCKETS[0]
        self.root = root or scratch(spark, "orphans")
        self.state = self._state(0, [])
        self.snapshots: list[DataFrame] = []

    @classmethod
    def resume(cls, spark: SparkSession, root: str) -> OrphanTracker:
        """The tracker with the state of the last step below ``root`` that was written to its end."""
        tracker = cls(spark, root)
        fs, folder = hadoop(spark, root)
        steps = [int(x.getPath().getName()) for x in (fs.listStatus(folder) if fs.exists(folder) else []) if x.getPath().getName().isdigit()]
        for n in sorted(steps, reverse=True):
            _, at = hadoop(spark, f"{root}/{n}/manifest.json")
            if fs.exists(at):
                text = spark.read.text(f"{root}/{n}/manifest.json", wholetext=True).first()[0]
                tracker.buckets = json.loads(text)["buckets"]
                tracker.state = tracker._state(n, json.loads(text)["logs"])
                break
        return tracker

    # -- tables --------------------------------------------------------------------------------------------------

    def _path(self, table: str, log: str) -> str:
        return f"{self.root}/{table}/log={log}"

    def _read(self, logs: list[str], table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table in some logs; only the folders of the buckets asked for are read."""
        ddl = _INDEX_LOG if table == "index" else _REFS_LOG
        if not logs:
            return self.spark.createDataFrame([], ddl)
        rows = self.spark.read.schema(ddl).option("basePath", f"{self.root}/{table}").parquet(*[self._path(table, log) for log in logs])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))

    @staticmethod
    def _standing(rows: DataFrame) -> DataFrame:
        """The last standing of each reference in rows of logs."""
        return rows.groupBy("bucket", *_IDENTITY).agg(F.min("ingested_at").alias("ingested_at"), F.max_by("standing", "step").alias("standing"))

    def _waiting(self, logs: list[str], buckets: list[int] | None = None) -> DataFrame:
        """Pending references. Those that were resolved at once have never waited and aren't read."""
        return self._standing(self._read(logs, "refs", buckets).where("standing != 'resolved'")).where("standing = 'pending'")

    def _state(self, number: int, logs: list[str]) -> OrphanState:
        ref = [*REF_ID, "space", "keys", "seen_at", "ingested_at"]
        index = self._read(logs, "index")
        index = _latest(index) if len(logs) > 1 else index
        return OrphanState(
            index.select("space", "key", "live_from", "live_to", "ingested_at"), self._waiting(logs).select(*ref), self._standing(self._read(logs, "refs")).where("standing != 'pending'").select(*ref), number, logs
        )

    def _bucket(self, key) -> F.Column:
        return F.pmod(F.xxhash64("space", base(F.col("space"), key)), F.lit(self.buckets)).cast("int")

    def _touched(self, path: str) -> list[int]:
        """The buckets that a table written just now has rows in: its folders."""
        fs, at = hadoop(self.spark, path)
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if "=" in x.getPath().getName())

    @staticmethod
    def _write(df: DataFrame, path: str, order: str | None = None) -> None:
        """A folder for each bucket; within its files rows in an order, so that a filter on it skips pages."""
        ordered = df.sortWithinPartitions("bucket", order) if order else df
        ordered.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)

    # -- steps ---------------------------------------------------------------------------------------------------

    def step(self, refs: DataFrame, arrived: DataFrame, count: bool = False) -> OrphanState:
        """Take in a batch of references and of parents; with ``count`` keep a snapshot of the counts."""
        old, n = self.state, self.state.number + 1
        log = f"{n}"
        self._write(_latest(arrived.withColumn("bucket", self._bucket(F.col("key")))).repartition("bucket"), self._path("index", log))
        delta = self._read([log], "index").withColumn("_new", F.lit(True))
        asked = refs.withColumn("bucket", self._bucket(F.element_at("keys", 1))).withColumn("_was", F.lit(None).cast("string"))
        if old.logs:
            moved = self._touched(self._path("index", log))
            wanted = sorted({*moved, *(r[0] for r in asked.select("bucket").distinct().collect())})  # no more than there are buckets
            both = self._read(old.logs, "index", wanted).withColumn("_new", F.lit(False)).unionByName(delta)
            before = [F.expr(f"max_by({_ENDS}, {_RANK}) FILTER (WHERE NOT _new)").alias("_before"), F.max("_new").alias("_new")]
            index = _latest(both, *before).withColumn("_changed", F.col("_new") & (F.col("_before").isNull() | (F.col("_before") != F.expr(_ENDS))))
            shortened = index.where(F.col("_changed") & (F.expr(_ENDS) < F.col("_before"))).select("bucket", "space", "key", "live_to", "_before")
            waiting = self._waiting(old.logs, moved).select(*asked.columns[:-1], F.lit("pending").alias("_was"))
            asked = asked.unionByName(waiting)
            if moved and not shortened.isEmpty():
                asked = asked.unionByName(self._reopened(old.logs, moved, shortened).select(*asked.columns))
        else:
            index = delta.withColumn("_changed", F.lit(True))
        judged = self._probe(asked, index)
        # What is new is written, and what waited or was resolved if that has changed.
        standing = F.when(F.col("open"), "pending").when(F.col("_known"), "settled").otherwise("resolved")
        kept = judged.where(F.col("_fresh") | (F.col("open") != F.col("_waited"))).withColumn("standing", standing).withColumn("step", F.lit(n))
        self._write(kept.select(*[f.split()[0] for f in REFS.split(", ")], "step", "standing", "bucket"), self._path("refs", log), "standing")
        logs = [*old.logs, log]
        if len(logs) > MAX_LOGS:
            logs = [self._together(logs, n)]
        self._commit(n, logs)
        self.state = self._state(n, logs)
        if count:
            path = f"{self.root}/{n}/counts"
            self.counts().coalesce(1).write.mode("overwrite").parquet(path)
            self.snapshots.append(self.spark.read.parquet(path).withColumn("step", F.lit(n)))
        return self.state

    def _reopened(self, logs: list[str], buckets: list[int], shortened: DataFrame) -> DataFrame:
        """References that are not pending and that one of the shortened lives has resolved; joined by key, hot ones dealt over several tasks."""
        rows = self._read(logs, "refs", buckets).withColumn("key", F.explode("keys"))
        hot = hot_keys(rows, ["space", "key"])
        left = salt_left(rows, ["space", "key"], hot, _IDENTITY)
        seen = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', seen_at)")
        right = salt_right(shortened.select("space", "key", F.expr(_ENDS).alias("_end"), "_before"), ["space", "key"], hot)
        met = left.join(right, ["space", "key", "_salt"]).where((seen >= F.col("_end")) & (seen < F.col("_before")))
        return self._standing(met).where("standing != 'pending'").withColumn("_was", F.lit("resolved"))

    @staticmethod
    def _probe(asked: DataFrame, index: DataFrame) -> DataFrame:
        """Each distinct reference once, with ``open``: no key hit a live parent. References that wait only look at what has changed.

        The references of a hot base are dealt over SALTS tasks; the parents of that base are repeated there. Rows come out by bucket."""
        asked = asked.withColumn("_base", base(F.col("space"), F.element_at("keys", 1)))
        hot = hot_keys(asked, ["space", "_base"])
        left = salt_left(asked, ["space", "_base"], hot, [*REF_ID, "ingested_at"]).withColumn("key", F.explode("keys"))
        right = index.withColumn("_base", base(F.col("space"), F.col("key"))).select("space", "_base", "key", "live_from", "live_to", "_changed")
        right = salt_right(right, ["space", "_base"], hot).withColumn("_hit", F.lit(True))
        live = (right["live_from"].isNull() | (left["seen_at"] >= right["live_from"])) & (right["live_to"].isNull() | (left["seen_at"] < right["live_to"]))
        waited = F.coalesce(left["_was"] == "pending", F.lit(False))
        on = (left["space"] == right["space"]) & (left["key"] == right["key"]) & (left["_salt"] == right["_salt"]) & (~waited | right["_changed"]) & live
        met = left.join(right, on, "left").select(left["bucket"], left["_salt"], *REF_ID, left["space"], left["keys"], left["seen_at"], left["ingested_at"], left["_was"], "_hit")
        # Grouped by the whole row but its time of arrival, where it is written: copies fall together, and the buffers are of fixed size, so that rows are hashed.
        return met.repartition("bucket", "_salt").groupBy("bucket", "_salt", *_IDENTITY).agg(
            F.min("ingested_at").alias("ingested_at"), F.max("_hit").isNull().alias("open"), F.max(F.col("_was").isNull()).alias("_fresh"), F.max(F.col("_was").isNotNull()).alias("_known"), F.max(F.coalesce(F.col("_was") == "pending", F.lit(False))).alias("_waited"),
        )

    def _together(self, logs: list[str], n: int) -> str:
        """One log with what the given ones come to."""
        log = f"{n}-all"
        self._write(_latest(self._read(logs, "index")).repartition("bucket"), self._path("index", log))
        refs = self._standing(self._read(logs, "refs")).withColumn("standing", F.when(F.col("standing") == "pending", "pending").otherwise("resolved")).withColumn("step", F.lit(n))
        self._write(refs.repartition("bucket", F.pmod(F.xxhash64(*REF_ID), F.lit(4))), self._path("refs", log), "standing")
        return log

    def _commit(self, n: int, logs: list[str]) -> None:
        fs, at = hadoop(self.spark, f"{self.root}/{n}/manifest.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"number": n, "buckets": self.buckets, "logs": logs}).encode()))
        out.close()

    def vacuum(self) -> int:
        """Delete what no log of the current state uses; earlier states can't be read then."""
        n = 0
        for table in ("index", "refs"):
            fs, at = hadoop(self.spark, f"{self.root}/{table}")
            for x in fs.listStatus(at) if fs.exists(at) else []:
                n += x.getPath().getName() not in {f"log={log}" for log in self.state.logs} and bool(fs.delete(x.getPath(), True))
        return n

    # -- reports -------------------------------------------------------------------------------------------------

    def orphans(self) -> DataFrame:
        """Pending orphans, each key once: ``period`` is the month in which it was first seen, or arrived where that isn't known;
        ``reason`` is ``never`` if no parent ever had the key, ``not yet`` if the first came later, else ``no longer``."""
        asked = self.state.pending.select(*REF_ID, "space", F.coalesce("seen_at", "ingested_at").alias("_at"), F.explode("keys").alias("key"))
        hot = hot_keys(asked, ["space", "key"])
        began = self.state.index.groupBy("space", "key").agg(F.min("live_from").alias("_first"), F.count(F.lit(1)).alias("_n"))
        met = salt_left(asked, ["space", "key"], hot, REF_ID).join(salt_right(began, ["space", "key"], hot), ["space", "key", "_salt"], "left")
        first = met.groupBy(*REF_ID).agg(F.min("_at").alias("_at"), F.min("_first").alias("_first"), F.count("_n").alias("_known"))
        reason = F.when(F.col("_known") == 0, "never").when(F.col("_first") > F.col("_at"), "not yet").otherwise("no longer")
        return first.select(*REF_ID, F.date_format("_at", "yyyy-MM").alias("period"), reason.alias("reason"))

    def counts(self) -> DataFrame:
        """Pending orphans by table, field, month and reason."""
        return self.orphans().groupBy("src_table", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def buckets_for(refs: DataFrame) -> int:
    """Buckets for a history of the size that the optimizer estimates for it; reads nothing."""
    size = int(refs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(BUCKETS[0], min(BUCKETS[1], size // BUCKET_BYTES))


def cut_points(refs: DataFrame, steps: int) -> list:
    """Times that divide the arrivals of ``refs`` into ``steps`` spans of equal length."""
    first, last = refs.agg(F.min("ingested_at"), F.max("ingested_at")).first() if steps > 1 else (None, None)
    return [first + (last - first) * k / steps for k in range(1, steps)] if first is not None else []


def track(spark: SparkSession, refs: DataFrame, arrived: DataFrame, steps: int = 2, count: bool = False, cuts: list | None = None) -> OrphanTracker:
    """Replay both histories in order of arrival, in ``steps`` spans of equal length or cut at given times. The result is the same for any number of steps."""
    tracker = OrphanTracker(spark, buckets=buckets_for(refs))
    cuts = cut_points(refs, steps) if cuts is None else cuts
    for low, high in zip([None, *cuts], [*cuts, None]):
        at = F.col("ingested_at")
        within = (F.lit(True) if low is None else at >= F.lit(low).cast("timestamp_ntz")) & (F.lit(True) if high is None else (at < F.lit(high).cast("timestamp_ntz")))
        if low is None:
            within = within | at.isNull()
        tracker.step(refs.where(within), arrived.where(within), count)
    return tracker
