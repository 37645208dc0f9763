"""The symbol table and lookups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import FAR_BYTES, levenshtein, short_name, signature
from marginalia.runtime import hot_keys, salt_left, salt_right

#: Fixed: kinds in the order in which a module's declarations are registered.
ORDER = {"function": 0, "struct": 1, "enum": 2, "typedef": 3, "class": 4, "method": 5}


def candidates(entities: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Every key that a declaration may be found by: the full name, the short name, a unique name given in its documentation
    (one that begins with ``*`` in the scope of the declaration; without a scope that one is no key) and, with parameters, the signature.

    ``place`` orders all registrations: module order, kind, order in the module, then full before short names."""
    kinds = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])
    own = entities.where(F.col("kind").isin(*ORDER)).select("entity_id", "module", "kind", "name", "qualified_name", "ord", *(["doc"] if "doc" in entities.columns else []))
    keys = [F.struct(F.lit(0).alias("rank"), F.col("qualified_name").alias("key")), F.struct(F.lit(1).alias("rank"), short_name(F.col("qualified_name")).alias("key"))]
    if "doc" in own.columns and "unique_name" in own.schema["doc"].dataType.names:
        given = F.col("doc.unique_name")
        scope = F.regexp_extract("qualified_name", "^(.*::)[^:]*$", 1)
        unique = F.when(~given.startswith("*"), given).when(scope != "", F.concat(scope, F.substr(given, F.lit(2))))
        keys.append(F.when(unique.isNotNull(), F.struct(F.lit(2).alias("rank"), unique.alias("key"))))
    if params is not None:
        typed = params.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type_str"))), lambda p: p["type_str"]).alias("_types"))
        own = own.join(typed, "entity_id", "left")
        keys.append(F.when(F.size("_types") > 0, F.struct(F.lit(3).alias("rank"), signature(F.col("qualified_name"), F.col("_types")).alias("key"))))
    place = F.struct(F.col("module"), kinds[F.col("kind")].alias("k"), F.col("ord"), F.col("_k.rank").alias("r"), F.col("entity_id"))
    return own.withColumn("_k", F.explode(F.array_compact(F.array(*keys)))).select(F.col("_k.key").alias("lookup_key"), "kind", F.col("module").alias("source_file"), F.col("qualified_name").alias("name"), F.col("entity_id"), place.alias("place"))


def symbol_table(entities: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """One row for each key: the first registration wins.

    A declaration whose full name is taken adds no short and no unique name, so the fold is resolved in two steps: first the full
    names, then the other keys of those that got theirs, where a full name beats a short one that comes later only.
    Both are aggregations with partial results; no group is ever collected."""
    from marginalia.functions.exprs import anchor

    cand = candidates(entities, params)
    full = cand.where(F.col("place.r") == 0).groupBy("lookup_key").agg(F.min_by("entity_id", "place").alias("entity_id"))
    owners = full.select("entity_id").distinct()
    usable = cand.where(F.col("place.r") == 0).unionByName(cand.where(F.col("place.r").isin(1, 2)).join(owners, "entity_id", "left_semi")).unionByName(cand.where(F.col("place.r") == 3))
    first = usable.groupBy("lookup_key").agg(F.min_by(F.struct("kind", "source_file", "name", "entity_id"), "place").alias("_w"))
    return first.select("lookup_key", F.col("_w.kind").alias("kind"), F.col("_w.source_file").alias("source_file"), anchor(F.col("_w.name")).alias("anchor"), F.col("_w.name").alias("name"))


def live_symbols(symbols: DataFrame) -> DataFrame:
    """Each key once; of several rows the one added first, then by file and anchor."""
    order = F.struct("added_at", "source_file", "anchor", "kind", "name") if "added_at" in symbols.columns else F.struct("source_file", "anchor", "kind", "name")
    return symbols.groupBy("lookup_key").agg(F.min_by(F.struct("kind", "source_file", "anchor", "name"), order).alias("_s")).select("lookup_key", "_s.*")


def lookup(queries: DataFrame, key: str, symbols: DataFrame) -> DataFrame:
    """Exact lookup; queries without a symbol keep nulls. The optimizer picks broadcast or shuffle by size."""
    return queries.join(symbols, queries[key] == symbols["lookup_key"], "left")


def scopes(scope: Column, name: Column) -> Column:
    """``scope::name``, the same in each enclosing scope, then the global name: structs (rank, key)."""
    parts = F.when(F.coalesce(scope, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(scope, "::"))
    steps = F.sequence(F.lit(0), F.size(parts))
    return F.transform(steps, lambda n: F.struct(n.alias("rank"), F.concat_ws("::", F.slice(parts, F.lit(1), F.size(parts) - n), F.array(name)).alias("key")))


def scoped_lookup(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each query (query_id, scope, name) the symbol in the innermost scope that has one."""
    probes = queries.select("query_id", F.explode(scopes(F.col("scope"), F.col("name"))).alias("_p")).select("query_id", "_p.rank", "_p.key")
    hits = probes.join(symbols.select("lookup_key"), F.col("key") == F.col("lookup_key"))
    best = hits.groupBy("query_id").agg(F.min_by("lookup_key", "rank").alias("lookup_key"))
    return queries.select("query_id").distinct().join(best, "query_id", "left")


def suffixes(key: Column) -> Column:
    """The key and what follows each of its ``::``."""
    parts = F.split(key, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts) - n + 1), "::"))


def fuzzy_lookup(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Scoped lookup first; else the least key that is the name or ends with ``::name``. Suffixes make the theta join an equi-join."""
    scoped = scoped_lookup(queries, symbols)
    rest = scoped.where("lookup_key is null").select("query_id").join(queries.select("query_id", "name").distinct(), "query_id")
    ends = symbols.select("lookup_key", F.explode(suffixes(F.col("lookup_key"))).alias("_end")).groupBy("_end").agg(F.min("lookup_key").alias("lookup_key"))
    late = rest.join(ends, F.col("name") == F.col("_end"), "left").select("query_id", "lookup_key")
    return scoped.where("lookup_key is not null").unionByName(late)


def _pieces(text: Column, count: int) -> Column:
    """A text cut into ``count`` pieces of nearly equal length: structs (n, start, piece)."""
    size = F.length(text)
    edge = lambda n: F.floor(size * n / count).cast("int")
    return F.array(*[F.struct(F.lit(n).alias("n"), edge(n).alias("start"), F.substr(text, edge(n) + 1, edge(n + 1) - edge(n)).alias("piece")) for n in range(count)])


def _alignments(text: Column, limit: int) -> Column:
    """All ways to keep up to ``limit`` characters of a short text: structs (kept, gaps), gaps being the characters left out before, between and behind them."""
    size = F.length(text)
    masks = F.filter(F.sequence(F.lit(0), F.pow(F.lit(2), size).cast("int") - 1), lambda m: (F.bit_count(m) <= limit) & (size - F.bit_count(m) <= limit))
    last = lambda g: F.element_at(g, -1)
    start = F.struct(F.lit("").alias("kept"), F.array(F.lit(0)).alias("gaps"))
    step = lambda m: lambda acc, i: F.when(
        F.getbit(m, i - 1) == 1, F.struct(F.concat(acc["kept"], F.substr(text, i, F.lit(1))).alias("kept"), F.concat(acc["gaps"], F.array(F.lit(0))).alias("gaps"))
    ).otherwise(F.struct(acc["kept"].alias("kept"), F.concat(F.slice(acc["gaps"], F.lit(1), F.size(acc["gaps"]) - 1), F.array(last(acc["gaps"]) + 1)).alias("gaps")))
    return F.transform(masks, lambda m: F.aggregate(F.sequence(F.lit(1), size), start, step(m)))


def _near_short(asked: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """Of queries with no more than ``limit`` characters, which can't be cut into pieces, the best names with their distance.

    The edit distance is the least cost of an alignment: characters kept by both, and between them gaps that cost the longer
    of the two. So names are put together by what they keep and their gaps, the least name standing for all: a few dozen rows
    for each kept text whatever the number of names, joined by equality with what the queries keep."""
    rows = lambda df, c: df.select(c, F.explode(_alignments(F.col(c), limit)).alias("_x")).select(c, F.col("_x.kept").alias("_kept"), F.col("_x.gaps").alias(f"_{c}"))
    theirs = rows(names.where(F.length("name") <= 2 * limit), "name").groupBy("_kept", "_name").agg(F.min("name").alias("name"))
    mine = rows(asked, "query")
    hot = hot_keys(mine, ["_kept"])
    met = salt_left(mine, ["_kept"], hot, ["query"]).join(salt_right(theirs, ["_kept"], hot), ["_kept", "_salt"])
    cost = F.aggregate(F.zip_with("_query", "_name", lambda a, b: F.greatest(a, b)), F.lit(0), lambda n, x: n + x)
    return met.select("query", "name", cost.alias("distance")).where(F.col("distance") <= limit)


def similar(queries: DataFrame, names: DataFrame, limit: int = 3) -> DataFrame:
    """For each ``query`` the nearest ``name`` within ``limit`` edits, of equally near ones the least.

    A name within ``limit`` edits contains one of ``limit + 1`` pieces of the query unchanged, moved by at most ``limit``
    places. Pieces with their places are joined by equality, so that only likely pairs are measured; names longer than
    the distance's own bound can't be near and are left out first."""
    short = lambda c: (F.octet_length(c) <= FAR_BYTES) & (F.length(c) > 0)
    asked = queries.select("query").distinct().where(short("query"))
    names = names.select("name").distinct().where(short("name"))
    q = asked.where(F.length("query") > limit)
    own = q.select("query", F.length("query").alias("_m"), F.explode(_pieces(F.col("query"), limit + 1)).alias("_p")).select("query", "_m", F.col("_p.n").alias("_n"), F.col("_p.start").alias("_s"), F.col("_p.piece").alias("_piece"))
    # For each length that a query may have, where its pieces would begin, moved by every shift.
    spread = names.select("name", F.explode(F.sequence(F.greatest(F.lit(limit + 1), F.length("name") - limit), F.length("name") + limit)).alias("_m")).select("name", "_m", F.explode(F.sequence(F.lit(0), F.lit(limit))).alias("_n"))
    start, end = F.floor(F.col("_m") * F.col("_n") / (limit + 1)).cast("int"), F.floor(F.col("_m") * (F.col("_n") + 1) / (limit + 1)).cast("int")
    moved = spread.select("name", "_m", "_n", start.alias("_s"), (end - start).alias("_l"), F.explode(F.sequence(F.lit(-limit), F.lit(limit))).alias("_d")).where((F.col("_s") + F.col("_d") >= 0) & (F.col("_s") + F.col("_d") + F.col("_l") <= F.length("name")))
    theirs = moved.select("name", "_m", "_n", F.substr("name", F.col("_s") + F.col("_d") + 1, F.col("_l")).alias("_piece")).distinct()
    pairs = own.join(theirs, ["_m", "_n", "_piece"]).select("query", "name", levenshtein(F.col("query"), F.col("name")).alias("distance")).where(F.col("distance") <= limit)
    pairs = pairs.unionByName(_near_short(asked.where(F.length("query") <= limit), names, limit))
    return pairs.groupBy("query").agg(F.min(F.struct("distance", "name")).alias("_b")).select("query", F.col("_b.name").alias("suggestion"), F.col("_b.distance").alias("distance"))
