"""Inheritance and include graphs.

Closures are iterated joins: each round extends the newest paths by one edge, drops those known, and is written to
the shared folder, so lineage doesn't grow and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import basename, class_simple_name
from marginalia.runtime import materialize

#: Fixed: depth to which diagrams follow a graph.
MAX_DEPTH = 5


def class_nodes(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """Classes, and bases that are no known class as external ones: name, is_external, is_abstract."""
    own = classes.groupBy("name").agg(F.lit(False).alias("is_external"), F.max(F.coalesce(F.col("is_abstract"), F.lit(False))).alias("is_abstract"))
    lost = bases.select(F.col("parent").alias("name")).distinct().join(own.select("name"), "name", "left_anti")
    return own.unionByName(lost.select("name", F.lit(True).alias("is_external"), F.lit(False).alias("is_abstract")))


def abstract_classes(methods: DataFrame) -> DataFrame:
    """Classes with a pure virtual method."""
    return methods.groupBy("parent_id").agg(F.max(F.coalesce(F.col("flags")["is_pure_virtual"], F.lit(False))).alias("is_abstract"))


def match_bases(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """Edges child -> parent by simple name, without namespaces and template arguments."""
    known = classes.select(F.col("name").alias("parent"), class_simple_name(F.col("name")).alias("_k")).distinct()
    return bases.withColumn("_k", class_simple_name(F.col("base"))).join(known, "_k", "left").select("child", F.coalesce("parent", "base").alias("parent"), "pos")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    return nodes.select("name").distinct().join(edges.select(F.col("child").alias("name")).distinct(), "name", "left_anti")


def children(edges: DataFrame, parent: str) -> DataFrame:
    return edges.where(F.col("parent") == parent).select("child").distinct()


def parents(edges: DataFrame, child: str) -> DataFrame:
    return edges.where(F.col("child") == child).select("parent").distinct()


def closure(edges: DataFrame, max_depth: int | None = MAX_DEPTH, seeds: DataFrame | None = None) -> DataFrame:
    """Every (start, reached, depth) with the least depth, along edges (src, dst); cycles end where they close.

    Work in a round is that of the newest pairs only. With ``max_depth`` None it goes on until nothing is new."""
    edges = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "graph-edges")
    first = edges.select(F.col("src").alias("start"), F.col("dst").alias("reached"), F.lit(1).alias("depth"))
    if seeds is not None:
        first = first.join(seeds.select(F.col("name").alias("start")).distinct(), "start", "left_semi")
    known = newest = materialize(first, "graph-reached")
    depth = 1
    while (max_depth is None or depth < max_depth) and not newest.isEmpty():
        depth += 1
        step = newest.join(edges, newest["reached"] == edges["src"]).select("start", F.col("dst").alias("reached")).distinct()
        newest = materialize(step.join(known.select("start", "reached"), ["start", "reached"], "left_anti").withColumn("depth", F.lit(depth)), "graph-reached")
        known = known.unionByName(newest)
    return known


def first_parent_root(edges: DataFrame) -> DataFrame:
    """The root of each child when only the first parent (pos least) is followed, through chains of any length.

    Pointers are doubled, so a chain of n takes log n rounds. Where the chain runs into a cycle there is no root: it is null."""
    one = edges.groupBy("child").agg(F.min_by("parent", F.struct("pos", "parent")).alias("up"))
    jump = materialize(one, "graph-jump")
    nodes, steps = jump.count(), 1
    while True:
        up = jump.select(F.col("child").alias("up"), F.col("up").alias("_next"))
        moved = materialize(jump.join(up, "up", "left").select("child", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_m")), "graph-jump")
        steps *= 2
        if moved.where("_m").isEmpty():
            return moved.select("child", F.col("up").alias("root"))
        if steps > 2 * nodes:  # a pointer was longer than any chain: whoever still moves goes round in a cycle
            return moved.select("child", F.when(~F.col("_m"), F.col("up")).alias("root"))
        jump = moved.drop("_m")


def nesting(entities: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All ancestors of each declaration through parent_id."""
    return closure(entities.where("parent_id is not null").select(F.col("entity_id").alias("src"), F.col("parent_id").alias("dst")), max_depth)


def include_edges(includes: DataFrame, show_system: bool = False) -> DataFrame:
    """Edges between basenames, each include line one."""
    kept = includes if show_system else includes.where("not is_system")
    return kept.select(basename(F.col("module")).alias("src"), basename(F.col("path")).alias("dst"))


def include_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()


def dependents(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Who includes a file, directly or not."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth, seeds)


def _node_id(name) -> F.Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


def include_mermaid(edges: DataFrame) -> DataFrame:
    """The lines of a diagram; edges of a hub can be many, so they stay rows with their order."""
    nodes = include_nodes(edges).select(F.lit(1).alias("part"), F.concat(F.lit("    "), _node_id(F.col("name")), F.lit('["'), F.col("name"), F.lit('"]')).alias("text"))
    lines = edges.select(F.lit(2).alias("part"), F.concat(F.lit("    "), _node_id(F.col("src")), F.lit(" --> "), _node_id(F.col("dst"))).alias("text"))
    return nodes.unionByName(lines)


def class_diagram(nodes: DataFrame, edges: DataFrame, style: str = "mermaid") -> DataFrame:
    """The lines of a class diagram: part orders headings, nodes and edges."""
    mermaid = style == "mermaid"
    indent = "    " if mermaid else ""
    node_id = _node_id(F.col("name")) if mermaid else F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    if mermaid:
        texts = [F.concat(F.lit(indent + "class "), node_id), F.when(F.col("is_abstract"), F.concat(F.lit(indent + "<<abstract>> "), node_id)), F.when(F.col("is_external"), F.concat(F.lit(indent + "<<external>> "), node_id))]
    else:
        texts = [F.concat(F.when(F.col("is_abstract"), F.lit("abstract ")).otherwise(F.lit("")), F.lit("class "), node_id, F.when(F.col("is_external"), F.lit(" <<external>>")).otherwise(F.lit("")))]
    body = nodes.select(F.lit(1).alias("part"), F.explode(F.array_compact(F.array(*texts))).alias("text"))
    kind = nodes.select(F.col("name").alias("parent"), F.col("is_abstract").alias("_a"))
    arrow = F.when(F.coalesce("_a", F.lit(False)), F.lit(" <|.. ")).otherwise(F.lit(" <|-- "))
    name = (lambda c: _node_id(F.col(c))) if mermaid else (lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"')))
    lines = edges.join(kind, "parent", "left").select(F.lit(2).alias("part"), F.concat(F.lit(indent), name("parent"), arrow, name("child")).alias("text"))
    return body.unionByName(lines)


def ascii_tree(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row for each node of the trees below the roots: path (for the order), depth and the indented text."""
    edges = materialize(edges.select("child", "parent").distinct(), "graph-tree-edges")
    top = edges.select(F.col("parent").alias("name")).distinct().join(edges.select(F.col("child").alias("name")), "name", "left_anti")
    level = materialize(top.select("name", F.array("name").alias("path"), F.lit(0).alias("depth")), "graph-tree")
    out = level
    for depth in range(1, max_depth + 1):
        step = level.join(edges, level["name"] == edges["parent"]).where(~F.array_contains("path", F.col("child")))
        level = materialize(step.select(F.col("child").alias("name"), F.concat("path", F.array("child")).alias("path"), F.lit(depth).alias("depth")), "graph-tree")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    mark = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.concat(F.expr("repeat('│   ', depth - 1)"), F.lit("├── ")))
    return out.select(F.array_join("path", "/").alias("path"), "depth", F.concat(mark, F.col("name")).alias("text"))
