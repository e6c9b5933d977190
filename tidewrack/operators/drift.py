"""Schemas that drift between the files of a stream: the changes of each file, and one consistent table.

Each file's schema is a tree: the columns, below them the fields of their JSON objects, and so on. The edit script between
the trees of two files that follow one another maps nodes to nodes at the least cost: a node that keeps its label below
the node its parent is mapped to costs nothing, one with another label is renamed, one with another parent moved; what is
left is deleted or added. Leaves map only where their values agree on the records that both files hold, the cheaper the
more records agree; objects map where their leaves do. Spark finds who agrees with whom; only nodes that may map reach the matching.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.keys import norm_key
from tidewrack.session import materialize

#: Costs of an edit script: of each node added, deleted, renamed (under one parent) or moved (to another), and of mapping leaves of one label that share no record.
ADD, DELETE, RENAME, MOVE, UNSEEN = 1.0, 1.0, 0.5, 0.75, 0.25
_FAR = 1e9
Path = tuple[str, ...]
_PATH = T.ArrayType(T.StringType())
_MAPPED = T.ArrayType(T.StructType([T.StructField("old", _PATH), T.StructField("new", _PATH), T.StructField("change", T.StringType())]))


def least_matching(cost: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest matching of a matrix with at least as many columns as rows."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while match[j0]:
            used[j0], i0, delta, j1 = True, match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _mapping(old: Sequence[Path], new: Sequence[Path], cost: dict[tuple[Path, Path], float]) -> dict[Path, Path]:
    """The cheapest mapping of ``old`` to ``new`` nodes along the pairs in ``cost``; whatever isn't mapped is deleted or added."""
    olds = [a for a in old if any((a, b) in cost for b in new)]
    news = [b for b in new if any((a, b) in cost for a in old)]
    if not olds:
        return {}
    matrix = [[cost.get((a, b), _FAR) - ADD for b in news] + [DELETE] * len(olds) for a in olds]
    chosen = least_matching(matrix)
    return {a: news[j] for a, row, j in zip(olds, matrix, chosen, strict=True) if j < len(news) and row[j] < DELETE}


def edit_script(old: Sequence[Path], new: Sequence[Path], agree: dict[tuple[Path, Path], int]) -> list[tuple[str, Path, Path]]:
    """(change, old path, new path) of the nodes that only one of two trees has and that map to one another; the other such nodes are deleted or added.

    ``agree`` holds, of leaves and objects whose values agree, on how many records. Objects are mapped first, by the
    estimated cost of what lies below them, from the top down; then all leaves together, at the least cost there is given the objects.
    ``kept`` are nodes that keep their label under a mapped parent. Nodes that both trees have map to themselves.
    """
    gone, come = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    inner = lambda nodes: {p[:n] for p in nodes for n in range(1, len(p))}
    old_inner, new_inner = inner(old) & set(gone), inner(new) & set(come)
    children: dict[Path, list[Path]] = {}
    for p in (*gone, *come):
        children.setdefault(p[:-1], []).append(p)
    size = lambda p: 1 + sum(size(c) for c in children.get(p, ()))
    known: dict[tuple[Path, Path], float] = {}

    def below(a: Path, b: Path) -> float:
        """Least cost of the children of a against those of b."""
        if (a, b) not in known:
            of_a, of_b = [c for c in children.get(a, ()) if c in gone_set], [c for c in children.get(b, ()) if c in come_set]
            saved, n = {}, max(len(of_a), len(of_b))
            for x in of_a:
                for y in of_b:
                    if (k := own(x, y)) is not None:
                        saved[x, y] = k + below(x, y) - size(x) - size(y)
            if n:
                matrix = [[min(0.0, saved.get((x, y), 0.0)) for y in of_b] + [0.0] * len(of_a) for x in of_a]
                gain = sum(matrix[i][j] for i, j in enumerate(least_matching(matrix))) if of_a else 0.0
            else:
                gain = 0.0
            known[a, b] = sum(map(size, of_a)) * DELETE + sum(map(size, of_b)) * ADD + gain
        return known[a, b]

    def own(a: Path, b: Path) -> float | None:
        """Cost of mapping two nodes whose parents map to each other; None: they can't."""
        if (a in old_inner) != (b in new_inner):
            return None
        n = agree.get((a, b))
        if a in old_inner:
            return (0.0 if a[-1] == b[-1] else RENAME) + (0.0 if n else UNSEEN)
        if n:
            return (0.0 if a[-1] == b[-1] else RENAME) + 0.2 / (1 + n)
        return UNSEEN if a[-1] == b[-1] else None

    gone_set, come_set = set(gone), set(come)
    mapped: dict[Path, Path] = {}
    together = lambda a, b: a[:-1] == b[:-1] or mapped.get(a[:-1]) == b[:-1]
    for depth in sorted({len(a) for a in old_inner}):
        level, free = [a for a in old_inner if len(a) == depth], sorted(new_inner - set(mapped.values()))
        cost = {}
        for a in sorted(level):
            for b in free:
                k = own(a, b) + (0.0 if together(a, b) else MOVE) + below(a, b) - size(a) - size(b) + 2
                if k < ADD + DELETE:
                    cost[a, b] = k
        mapped |= _mapping(sorted(level), free, cost)
    leaves, targets, cost = sorted(gone_set - old_inner), sorted(come_set - new_inner), {}
    for a, b in {*agree, *((a, mapped[a[:-1]] + a[-1:]) for a in leaves if a[:-1] in mapped)}:
        if a in gone_set and b in come_set and a not in old_inner and b not in new_inner:
            n = agree.get((a, b))
            if together(a, b):
                cost[a, b] = own(a, b)
            elif n:
                cost[a, b] = MOVE + 0.2 / (1 + n)
    mapped |= _mapping(leaves, targets, cost)
    change = lambda a, b: "moved" if not together(a, b) else "kept" if a[-1] == b[-1] else "renamed"
    return [(change(a, b), a, b) for a, b in sorted(mapped.items())]


@F.pandas_udf(_MAPPED)
def _scripts(old: pd.Series, new: pd.Series, agree: pd.Series) -> pd.Series:
    paths = lambda ps: [tuple(p) for p in ps]
    rows = (edit_script(paths(a), paths(b), {(tuple(p["old"]), tuple(p["new"])): p["n"] for p in ps}) for a, b, ps in zip(old, new, agree, strict=True))
    return pd.Series([[{"old": list(a), "new": list(b), "change": c} for c, a, b in r] for r in rows])


def json_fields(column: str) -> Column:
    """The first level of a JSON column as a map of variants; null where it is no object or no JSON."""
    return F.try_variant_get(F.try_parse_json(F.col(column)), "$", "map<string,variant>")


def _typed(level: DataFrame) -> DataFrame:
    """file_name, line_no, artifact, path, type, value (JSON text) of variants v; nulls have no row."""
    shape = F.schema_of_variant("v")
    kind = (
        F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape != "VOID", "number")
    )
    return level.select("file_name", "line_no", "artifact", "path", kind.alias("type"), F.to_json("v").alias("value")).where(F.col("type").isNotNull())


def field_rows(lines: DataFrame, columns: Sequence[str] = ("meta", "raw"), depth: int | None = 1) -> DataFrame:
    """file_name, line_no, artifact, path (column, name, ...), type, value (JSON text): one row for each non-null value, down to ``depth`` (None: all the way)."""
    parts = []
    for c in columns:
        x = lines.select("file_name", "line_no", norm_key(F.col("artifact_id")).alias("artifact"), F.explode(json_fields(c)).alias("k", "v"))
        parts.append(_typed(x.withColumn("path", F.array(F.lit(c), "k"))))
    levels = [reduce(DataFrame.unionByName, parts)]
    while depth is None or len(levels) < depth:
        above = levels[-1].where(F.col("type") == "object").withColumn("above", F.col("path"))
        x = materialize(_typed(above.select("file_name", "line_no", "artifact", "above", F.explode(json_fields("value")).alias("k", "v")).withColumn("path", F.concat("above", F.array("k")))))
        if x.isEmpty():
            break
        levels.append(x)
    return reduce(DataFrame.unionByName, levels)


def file_pairs(files: DataFrame, feed: str = "slack_01_clean") -> DataFrame:
    """file_name, stream, file_no, prev: the files of a feed, each with the one before it in its stream."""
    x = files.where((F.col("feed") == feed) & F.col("file_name").isNotNull()).groupBy("file_name").agg(F.min(F.struct("stream", "file_no")).alias("f")).select("file_name", "f.*")
    return x.withColumn("prev", F.lag("file_name").over(W.partitionBy("stream").orderBy("file_no", "file_name")))


def schema_scripts(lines: DataFrame, files: DataFrame, columns: Sequence[str] = ("meta", "raw"), depth: int | None = 1) -> DataFrame:
    """file_name, change, old, new (paths), sole: the edit script of each file against the one before it in its stream.

    Changes are ``added``, ``removed``, ``renamed``, ``moved``, ``retyped`` and, below an object that was renamed or moved,
    ``kept``. ``sole`` says of a mapped field that it agrees with no other, nor the other with any else.

    Null, empty, unreadable and non-object values have no fields. A file without lines has no fields. Rows that
    repeat in a file count once; an artifact with several values of a field in one file must agree in all of them.
    """
    rows = materialize(field_rows(lines, columns, depth).groupBy("file_name", "artifact", "path", "type", F.xxhash64("type", "value").alias("v")).agg(F.lit(1).alias("one")).drop("one"))
    pairs = file_pairs(files)
    schema = rows.groupBy("file_name", "path").agg(F.array_sort(F.collect_set("type")).alias("types"))
    now = pairs.where(F.col("prev").isNotNull()).select("file_name", "prev")
    new = now.join(schema, "file_name").select("file_name", "prev", "path", F.col("types").alias("new"))
    old = now.join(schema.withColumnRenamed("file_name", "prev"), "prev").select("file_name", "prev", "path", F.col("types").alias("old"))
    both = materialize(new.join(old, ["file_name", "prev", "path"], "full"))
    ended = both.where(F.col("new").isNull()).select("file_name", "prev", F.col("path").alias("old"), F.array_contains("old", "object").alias("inner"))
    began = both.where(F.col("old").isNull()).select("file_name", F.col("path").alias("new"), F.array_contains("new", "object").alias("inner"))
    was = rows.where(F.col("artifact").isNotNull()).select(F.col("file_name").alias("prev"), "artifact", F.col("path").alias("old"), F.col("v").alias("v_old")).join(ended.drop("inner"), ["prev", "old"])
    is_ = rows.where(F.col("artifact").isNotNull()).select("file_name", "artifact", F.col("path").alias("new"), F.col("v").alias("v_new")).join(began.drop("inner"), ["file_name", "new"])
    agree = was.join(is_, ["file_name", "artifact"]).groupBy("file_name", "old", "new").agg(F.bool_and(F.col("v_old") == F.col("v_new")).alias("same"), F.count_distinct("artifact").cast("int").alias("n"))
    agree = materialize(agree.where("same").drop("same"))

    def may_map(side: DataFrame, column: str) -> DataFrame:
        """Paths of each file that agree with one of the other side; with deeper trees also objects and what lies below them."""
        linked = agree.select("file_name", column)
        if depth != 1:
            nested = side.where(F.size(column) > 2).select("file_name", F.explode(F.transform(F.sequence(F.lit(2), F.size(column)), lambda n: F.slice(column, 1, n))).alias(column))
            linked = linked.unionByName(nested.join(side.select("file_name", column), ["file_name", column], "left_semi"))
        return linked.groupBy("file_name").agg(F.array_sort(F.collect_set(column)).alias(column))

    by_file = agree.groupBy("file_name").agg(F.collect_list(F.struct("old", "new", "n")).alias("agree"))
    trees = may_map(ended, "old").join(may_map(began, "new"), "file_name").join(by_file, "file_name", "left")
    trees = trees.withColumn("agree", F.coalesce("agree", F.array().cast(by_file.schema["agree"].dataType)))
    mapped = materialize(trees.select("file_name", F.explode(_scripts("old", "new", "agree")).alias("m")).select("file_name", "m.*"))
    partners = lambda c: agree.groupBy("file_name", c).agg(F.count("*").alias(f"n_{c}")).where(F.col(f"n_{c}") == 1)
    sole = agree.select("file_name", "old", "new").join(partners("old"), ["file_name", "old"], "left_semi").join(partners("new"), ["file_name", "new"], "left_semi").withColumn("sole", F.lit(True))
    out = mapped.join(sole, ["file_name", "old", "new"], "left").select("file_name", "change", "old", "new", F.coalesce("sole", F.lit(False)).alias("sole"))
    none = F.lit(None).cast(_PATH)
    removed = ended.join(mapped, ["file_name", "old"], "left_anti").select("file_name", F.lit("removed").alias("change"), "old", none.alias("new"), F.lit(False).alias("sole"))
    added = began.join(mapped, ["file_name", "new"], "left_anti").select("file_name", F.lit("added").alias("change"), none.alias("old"), "new", F.lit(False).alias("sole"))
    stays = both.where(F.col("new").isNotNull() & F.col("old").isNotNull() & (F.col("old") != F.col("new"))).select("file_name", F.lit("retyped").alias("change"), F.col("path").alias("old"), F.col("path").alias("new"), F.lit(False).alias("sole"))
    return reduce(DataFrame.unionByName, (out, removed, added, stays))


def schema_changes(lines: DataFrame, files: DataFrame, columns: Sequence[str] = ("meta", "raw")) -> DataFrame:
    """file_name, field, change, new_field: the edit scripts of the first level, with only those renames (and moves) that no other field could have.

    A rename that the script had to choose among several comes out as a removal and an addition.
    """
    x = schema_scripts(lines, files, columns)
    name = lambda c: F.concat(F.get(c, F.lit(0)), F.lit("."), F.get(c, F.lit(1)))
    row = lambda field, change, new: F.struct(name(field).alias("field"), F.lit(change).alias("change"), new.alias("new_field"))
    none = F.lit("")
    edit = (
        F.when(F.col("sole"), F.array(row("old", "renamed", name("new")))).when(F.col("change").isin("renamed", "moved", "kept"), F.array(row("old", "removed", none), row("new", "added", none)))
        .when(F.col("change") == "removed", F.array(row("old", "removed", none))).when(F.col("change") == "added", F.array(row("new", "added", none))).otherwise(F.array(row("old", "retyped", none)))
    )
    return x.select("file_name", F.explode(edit).alias("e")).select("file_name", "e.*")


def _next_end(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` (stream, field, no, ...) with ``end`` (no, to): the first of ``ends`` (stream, field, no, to) after them; null where none follows.

    One sorted pass over both for each field of a stream; no pairs of rows and ends are made.
    """
    payload = [c for c in rows.columns if c not in ("stream", "field", "no")]
    a = rows.select("stream", "field", "no", F.lit(0).alias("k"), F.struct(F.lit(1).alias("_"), *payload).alias("row"), F.lit(None).cast("struct<no:int,to:string>").alias("e"))
    b = ends.select("stream", "field", "no", F.lit(1).alias("k"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.struct(F.col("no").cast("int").alias("no"), "to").alias("e"))
    later = W.partitionBy("stream", "field").orderBy(F.desc("no"), "k").rowsBetween(W.unboundedPreceding, -1)
    x = a.unionByName(b).withColumn("end", F.last("e", ignorenulls=True).over(later)).where("k = 0")
    return x.select("stream", "field", "no", *[F.col(f"row.{c}").alias(c) for c in payload], "end")


def field_ends(files: DataFrame, changes: DataFrame) -> DataFrame:
    """stream, field, no, to: a field ends with file ``no`` of its stream and is called ``to`` at the stream's end; null: it was removed.

    The scripts' renames, chained: a rename leads on to the next end of its new name, if that is a rename. Chains are
    shortened by pointer doubling, so their number of rounds is the logarithm of their length.
    """
    place = file_pairs(files).select("file_name", "stream", F.col("file_no").cast("int").alias("no"))
    x = changes.where(F.col("change").isin("renamed", "removed")).join(place, "file_name")
    x = x.groupBy("stream", "field", "no").agg(F.max(F.when(F.col("change") == "renamed", F.col("new_field"))).alias("to"))
    ends = materialize(x)
    steps = ends.where(F.col("to").isNotNull()).select("stream", F.col("to").alias("field"), "no", F.col("field").alias("old"))
    links = _next_end(steps, ends).select("stream", F.col("old").alias("field"), "no", F.col("field").alias("to"), F.when(F.col("end.to").isNotNull(), F.col("end.no")).alias("next_no"))
    links = materialize(links)
    while not links.where(F.col("next_no").isNotNull()).isEmpty():
        on = links.select("stream", F.col("field").alias("to"), F.col("no").alias("next_no"), F.col("to").alias("to2"), F.col("next_no").alias("next2"))
        links = materialize(links.join(on, ["stream", "to", "next_no"], "left").select("stream", "field", "no", F.coalesce("to2", "to").alias("to"), F.when(F.col("to2").isNotNull(), F.col("next2")).alias("next_no")))
    return links.drop("next_no").unionByName(ends.where(F.col("to").isNull()))


def _named_entries(column: str) -> Column:
    """The fields of a JSON column as (key, moved, old, value), key being the name that ``projection`` gives."""

    def entry(kv: Column) -> Column:
        old = F.concat(F.lit(column + "."), kv["key"])
        key = F.coalesce(F.try_element_at(F.col("projection"), old), old)
        return F.struct(key.alias("key"), (key != old).alias("moved"), old.alias("old"), F.to_json(kv["value"]).alias("value"))

    empty = F.array().cast("array<struct<key:string,moved:boolean,old:string,value:string>>")
    return F.coalesce(F.transform(F.map_entries(json_fields(column)), entry), empty)


def unified_table(lines: DataFrame, files: DataFrame, columns: Sequence[str] = ("meta", "raw")) -> DataFrame:
    """file_name, line_no, artifact_id, fields (map of the name at the stream's end to JSON text): every line in one schema.

    The scripts are compiled into one projection a file, a map of old to last name, applied to its lines. Of two
    fields that end under one name the one that bore it counts.
    """
    place = file_pairs(files).select("file_name", "stream", F.col("file_no").cast("int").alias("no"))
    ends = field_ends(files, schema_changes(lines, files, columns))
    borne = field_rows(lines, columns).select("file_name", F.concat_ws(".", "path").alias("field")).distinct().join(place, "file_name").select("stream", "field", "no", "file_name")
    renamed = _next_end(borne, ends).where(F.col("end.to").isNotNull()).select("file_name", F.struct(F.col("field").alias("old"), F.col("end.to").alias("name")).alias("r"))
    projection = renamed.groupBy("file_name").agg(F.map_from_entries(F.array_sort(F.collect_list("r"))).alias("projection"))
    x = lines.select("file_name", "line_no", "artifact_id", *columns).join(projection, "file_name", "left")
    parts = [_named_entries(c) for c in columns]
    entries = F.array_sort(F.concat(*parts) if len(parts) > 1 else parts[0])  # by name at the end, own name first
    first = F.transform(F.array(entries), lambda es: F.filter(es, lambda e, i: (i == 0) | (e["key"] != F.get(es, i - 1)["key"])))
    fields = F.transform(F.get(first, F.lit(0)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return x.select("file_name", "line_no", "artifact_id", F.map_from_entries(fields).alias("fields"))
