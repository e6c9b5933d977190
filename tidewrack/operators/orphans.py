"""References to records that do not exist, down the foreign-key graph.

A reference is an orphan of its own (``missing``, ``deleted`` or ``late``), or inherits that from the record it
refers to, which is an orphan if one of its own references is. Inheritance is a fixpoint of semi-joins over any graph of
references: several fields of a table, chains over tables, tables that refer to each other or to themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.keys import norm_key, trimmed
from tidewrack.session import materialize


@dataclass(frozen=True)
class Reference:
    """Column ``field`` of ``table`` refers to the key of one of the ``targets``; ``key`` identifies the referring row."""

    table: str
    key: str
    field: str
    targets: tuple[str, ...]


#: The foreign keys of the message tables. Target names are tables; ``people`` are employees and externals.
MESSAGE_REFERENCES = (
    Reference("ticket", "artifact_id", "parent_id", ("ticket",)),
    Reference("email", "artifact_id", "sender_id", ("people",)),
    Reference("topic_evidence", "evidence_id", "artifact_id", ("email", "ticket", "slack_01_clean")),
)
#: The same, and replies among mails.
THREAD_REFERENCES = (*MESSAGE_REFERENCES, Reference("email", "artifact_id", "parent_id", ("email",)))
#: The keys of the tables that are referred to.
MESSAGE_KEYS = {"email": "artifact_id", "ticket": "artifact_id", "slack_01_clean": "artifact_id"}


def first_deliveries(rows: DataFrame, ref: Reference) -> DataFrame:
    """One row for each referring record: its first delivery (least loaded_at, null ones last, then least reference).

    Rows without key are no deliveries of one record; they count one for each distinct reference.
    """
    key = norm_key(F.col(ref.key))
    pick = F.min(F.struct(F.col("loaded_at").isNull().alias("undated"), F.col("loaded_at"), trimmed(F.col(ref.field)).alias("to"), trimmed(F.col(ref.key)).alias("row_key")))
    x = rows.groupBy(key.alias("k"), F.when(key.isNull(), norm_key(F.col(ref.field))).alias("k2")).agg(pick.alias("x"))
    return x.select(F.lit(ref.table).alias("ref_table"), F.lit(ref.field).alias("ref_field"), F.col("x.row_key").alias("row_key"), F.col("k").alias("row_id"), norm_key(F.col("x.to")).alias("to_id"), F.col("x.loaded_at").alias("loaded_at"))


def targets(tables: dict[str, DataFrame], keys: dict[str, str] = MESSAGE_KEYS) -> DataFrame:
    """(target, id, came_at, gone_at) of each record that may be referred to; gone_at is null while it exists.

    ``keys`` names the tables and their key columns; tables need loaded_at. Tombstones (source_table, artifact_id,
    deleted_at), employees and externals count if they are among the tables.
    """
    parts = [tables[name].select(F.lit(name).alias("target"), norm_key(F.col(key)).alias("id"), "loaded_at") for name, key in keys.items()]
    out = reduce(DataFrame.unionByName, parts).where(F.col("id").isNotNull()).groupBy("target", "id").agg(F.min("loaded_at").alias("came_at"))
    if "tombstones" in tables:
        gone = tables["tombstones"].groupBy(F.lower(trimmed(F.col("source_table"))).alias("target"), norm_key(F.col("artifact_id")).alias("id")).agg(F.min("deleted_at").alias("gone_at"))
        out = out.join(gone, ["target", "id"], "left")
    else:
        out = out.withColumn("gone_at", F.lit(None).cast("timestamp_ntz"))
    if "employees" not in tables:
        return out
    people = tables["employees"].select(norm_key(F.col("employee_id")).alias("id"), "loaded_at", "left_at").unionByName(
        tables["externals"].select(norm_key(F.col("entity_id")).alias("id"), "loaded_at", F.lit(None).cast("timestamp_ntz").alias("left_at"))
    )
    people = people.where(F.col("id").isNotNull()).groupBy(F.lit("people").alias("target"), "id").agg(F.min("loaded_at").alias("came_at"), F.min("left_at").alias("gone_at"))
    return out.unionByName(people)


def reference_states(tables: dict[str, DataFrame], refs: Sequence[Reference] = MESSAGE_REFERENCES, keys: dict[str, str] = MESSAGE_KEYS) -> DataFrame:
    """Each referring record with a reference that is neither null nor blank, and the kind of its fault (null: none).

    Of several targets of one id the earliest arrival and the last deletion count. Hot keys (a sender with a third
    of all mails) meet one row each on the other side; adaptive execution splits them.
    """
    all_targets = targets(tables, keys)
    out = None
    for ref in refs:
        rows = first_deliveries(tables[ref.table], ref).where(F.col("to_id").isNotNull())
        of = all_targets.where(F.col("target").isin(*ref.targets)).groupBy(F.col("id").alias("to_id")).agg(
            F.min("came_at").alias("came_at"), F.when(F.count("*") == F.count("gone_at"), F.max("gone_at")).alias("gone_at"), F.lit(True).alias("known")
        )
        kind = (
            F.when(F.col("known").isNull(), "missing")
            .when(F.col("gone_at") <= F.col("loaded_at"), "deleted")
            .when(F.col("came_at") > F.col("loaded_at"), "late")
        )
        x = rows.join(of, "to_id", "left").withColumn("kind", kind).drop("known", "came_at", "gone_at")
        out = x if out is None else out.unionByName(x)
    return out


def _least(parts: Sequence[DataFrame]) -> DataFrame:
    """id, best: the least of each record."""
    return reduce(DataFrame.unionByName, parts).where(F.col("id").isNotNull()).groupBy("id").agg(F.min("best").alias("best"))


def _from(best: Column, steps: Column | int) -> Column:
    return F.when(best.isNotNull(), F.struct((best["level"] + steps).cast("int").alias("level"), best["kind"].alias("kind")))


def _down_a_chain(best: DataFrame, up: DataFrame) -> DataFrame:
    """``best`` (id, best) and what it means for the records that refer to one another (``up``: id, to_id; of one field, so an id has one to_id).

    Pointer doubling: each record knows the least of the next ``dist`` records upwards, and who comes then. A round doubles
    that way, so their number is the logarithm of the longest chain. Records whose way ends drop out; on a cycle ways
    never end, and go on until they are longer than there are records left.
    """
    state = materialize(up.join(best, "id", "left").select("id", F.col("to_id").alias("up"), F.lit(1).cast("bigint").alias("dist"), "best"))
    if state.isEmpty():
        return best
    ends = best.join(state.select("id"), "id", "left_anti")
    step = state.select("id", "up", "dist", "best").unionByName(ends.select("id", F.lit(None).cast("string").alias("up"), F.lit(1).cast("bigint").alias("dist"), "best"))
    done, rounds = [], 0
    while True:
        on = step.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("best").alias("best2"))
        moved = state.join(on, "up", "left").select("id", F.col("up2").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.least("best", _from(F.col("best2"), F.col("dist"))).alias("best"))
        moved = materialize(moved)
        rounds += 1
        done.append(moved.where(F.col("up").isNull()))
        state = moved.where(F.col("up").isNotNull())
        left = state.count()
        if not left or 2**rounds > left:
            break
        step = reduce(DataFrame.unionByName, [*done, state]).unionByName(ends.select("id", F.lit(None).cast("string").alias("up"), F.lit(1).cast("bigint").alias("dist"), "best"))
    found = reduce(DataFrame.unionByName, [*done, state]).where(F.col("best").isNotNull()).select("id", "best")
    return _least([best, found])


def _order(refs: Sequence[Reference]) -> tuple[list[str], bool]:
    """The referring tables, each after those it refers to as far as that can be, and whether tables refer to each other in a circle."""
    left = {r.table: set() for r in refs}
    for r in refs:
        left[r.table] |= {t for t in r.targets if t in left and t != r.table}
    out, circle = [], False
    while left:
        free = [t for t in left if not left[t] & left.keys()]
        circle |= not free
        for t in free or [*left]:
            out.append(t)
            del left[t]
    return out, circle


def orphan_cascade(tables: dict[str, DataFrame], refs: Sequence[Reference] = MESSAGE_REFERENCES, keys: dict[str, str] = MESSAGE_KEYS) -> DataFrame:
    """ref_table, ref_field, row_key, kind, period, level: level 0 is an orphan of its own, level n inherits it over n references.

    Kinds of inherited orphans are the kind of the orphan they descend from (the first by name at the least level).
    Empty tables give no rows. Tables are taken in the order of their references, so those without circles once; circles of
    tables are gone round until no record gets a lesser level. Chains within a table take logarithmically many rounds.
    """
    states = materialize(reference_states(tables, refs, keys))
    direct = states.where(F.col("kind").isNotNull())
    open_ = states.where(F.col("kind").isNull()).drop("kind")
    order, circle = _order(refs)
    own_fields = {t: [r for r in refs if r.table == t and t in r.targets] for t in order}
    again = circle or any(len(f) > 1 for f in own_fields.values())
    best = {t: _least([direct.where(F.col("ref_table") == t).select(F.col("row_id").alias("id"), F.struct(F.lit(0).alias("level"), "kind").alias("best"))]) for t in order}

    def of(ref: Reference) -> DataFrame:
        return open_.where((F.col("ref_table") == ref.table) & (F.col("ref_field") == ref.field))

    def inherited(ref: Reference, sources: Sequence[str]) -> DataFrame:
        above = _least([best[s] for s in sources]).select(F.col("id").alias("to_id"), "best")
        return of(ref).join(above, "to_id").withColumn("best", _from(F.col("best"), 1))

    sums = None
    while True:
        for t in order:
            across = [(r, [s for s in r.targets if s in best and s != t]) for r in refs if r.table == t]
            parts = [inherited(r, sources).select(F.col("row_id").alias("id"), "best") for r, sources in across if sources]
            now = _least([best[t], *parts]) if parts else best[t]
            for r in own_fields[t]:
                now = _down_a_chain(materialize(now), of(r).where(F.col("row_id").isNotNull()).select(F.col("row_id").alias("id"), "to_id"))
            best[t] = materialize(now) if again or (parts and any(t in r.targets for r in refs)) else now
        if not again:
            break
        before, sums = sums, [best[t].agg(F.count("*"), F.sum("best.level"), F.sum(F.xxhash64("best.kind").cast("decimal(38,0)"))).head() for t in order]
        if sums == before:
            break
    parts = [direct.withColumn("level", F.lit(0))]
    for r in refs:
        sources = [s for s in r.targets if s in best]
        if sources:
            parts.append(inherited(r, sources).select(*[c for c in open_.columns], F.col("best.kind").alias("kind"), F.col("best.level").alias("level")))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("ref_table", "ref_field", "row_key", "kind", F.date_format("loaded_at", "yyyy-MM").alias("period"), "level")


def orphan_report(cascade: DataFrame) -> DataFrame:
    """Orphans per table, field, period and kind: of their own and inherited."""
    own = F.col("level") == 0
    return cascade.groupBy("ref_table", "ref_field", "period", "kind").agg(F.count_if(own).alias("direct"), F.count_if(~own).alias("inherited"))
