import datetime as dt
import random

from conftest import rows

from tidewrack.operators.orphans import THREAD_REFERENCES, Reference, orphan_cascade, orphan_report
from tidewrack.operators.ranking import rank_within


def at(day):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day)


def tables(spark):
    art = "artifact_id string, parent_id string, sender_id string, loaded_at timestamp_ntz, kind string"
    make = spark.createDataFrame
    return {
        "ticket": make(
            [
                ("T1", None, None, at(0), "x"), ("t2", " t1 ", None, at(1), "x"), ("t3", "gone", None, at(40), "x"), ("t4", "T3", None, at(41), "x"), ("t5", "t4", None, at(42), "x"), ("t6", "t7", None, at(2), "x"), ("t7", "", None, at(3), "x"),
                ("t8", "dead", None, at(9), "x"), ("dead", None, None, at(0), "x"), ("t9", "dead", None, at(1), "x"), ("t3", "t1", None, at(60), "x"), (None, "nothing", None, at(5), "x"), ("c1", "c2", None, at(5), "x"), ("c2", "c1", None, at(5), "x"),
            ],
            art,
        ),
        "email": make([("e1", None, "EMP_1", at(5), "x"), ("e2", None, "emp_9", at(5), "x"), ("e3", None, "EMP_2", at(5), "x"), ("e4", None, None, at(5), "x"), ("e5", None, "ext_1", at(0), "x")], art),
        "slack_01_clean": make([("s1", None, None, at(1), "x"), ("s1", None, None, at(8), "x")], art),
        "topic_evidence": make([("v1", "E2", at(6)), ("v2", "t5", at(50)), ("v3", "s1", at(0)), ("v4", "none", at(3)), ("v5", "S1 ", at(9)), ("v5", "none", at(10))], "evidence_id string, artifact_id string, loaded_at timestamp_ntz"),
        "employees": make([("EMP_1", at(0), None), ("EMP_2", at(0), at(4)), ("EMP_2", at(0), at(4))], "employee_id string, loaded_at timestamp_ntz, left_at timestamp_ntz"),
        "externals": make([("EXT_1", at(2))], "entity_id string, loaded_at timestamp_ntz"),
        "tombstones": make([("ticket", "DEAD", at(5)), ("email", "t1", at(0)), ("ticket", "never", at(0))], "source_table string, artifact_id string, deleted_at timestamp_ntz"),
    }


WANT = [
    ("email", "e2", "missing", "2026-01", 0), ("email", "e3", "deleted", "2026-01", 0), ("email", "e5", "late", "2026-01", 0),
    ("ticket", "t3", "missing", "2026-02", 0), ("ticket", "t4", "missing", "2026-02", 1), ("ticket", "t5", "missing", "2026-02", 2), ("ticket", "t6", "late", "2026-01", 0), ("ticket", "t8", "deleted", "2026-01", 0), ("ticket", None, "missing", "2026-01", 0),
    ("topic_evidence", "v1", "missing", "2026-01", 1), ("topic_evidence", "v2", "missing", "2026-02", 3), ("topic_evidence", "v3", "late", "2026-01", 0), ("topic_evidence", "v4", "missing", "2026-01", 0),
]


def test_kinds_and_levels(spark):
    t = tables(spark)
    c = orphan_cascade(t)
    assert rows(c, "ref_table", "row_key", "kind", "period", "level") == WANT
    report = rows(orphan_report(c), "ref_table", "period", "kind", "direct", "inherited")
    assert ("ticket", "2026-02", "missing", 1, 2) in report
    assert orphan_cascade({k: v.limit(0) for k, v in t.items()}).count() == 0


def test_ranks_within_groups_of_any_size(spark):
    df = spark.range(0, 5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 40) END AS k", "id * 7919 % 5003 AS v")
    by = {}
    for k, v in rows(df):
        by.setdefault(k, []).append(v)
    for k, v, r in rows(rank_within(df, ["k"], ["v"]), "k", "v", "rank"):
        assert sorted(by[k]).index(v) + 1 == r


GRAPH = (
    Reference("a", "k", "x", ("b",)), Reference("b", "k", "y", ("c", "d")), Reference("c", "k", "z", ("a",)), Reference("a", "k", "up", ("a",)), Reference("d", "k", "up", ("d",)), Reference("d", "k", "also", ("d",)),
)


def test_any_graph_of_references_equals_walking_it(spark):
    """Chains over tables, tables in a circle, several fields of a table to itself, cycles of records, long chains."""
    r = random.Random(5)
    data = {t: {} for t in "abcd"}
    for t in data:
        for i in range(60):
            row = {"k": f"{t}{i}"}
            for ref in (g for g in GRAPH if g.table == t):
                to = r.choice(ref.targets)
                row[ref.field] = r.choice([None, f"{to}{r.randrange(60)}", f"{to}{r.randrange(60)}", f"{to}{min(59, i + 1)}"]) if r.random() < 0.97 else "gone"
            data[t][row["k"]] = row
    for i in range(59):
        data["d"][f"d{i}"] = {"k": f"d{i}", "up": f"d{i + 1}", "also": None}  # a chain of 60
    data["d"]["d59"] = {"k": "d59", "up": "gone", "also": "d0"}
    frames = {}
    for t in data:
        fields = [g.field for g in GRAPH if g.table == t]
        frames[t] = spark.createDataFrame([(row["k"], at(0), *[row[f] for f in fields]) for row in data[t].values()], "k string, loaded_at timestamp_ntz, " + ", ".join(f"{f} string" for f in fields))
    owner = {k: t for t in data for k in data[t]}
    level = {}
    refs = [(g, k, row[g.field]) for g in GRAPH for k, row in data[g.table].items() if row[g.field]]
    for g, k, to in refs:
        if owner.get(to) not in g.targets:
            level[g.table, k] = 0
    direct = {(g.table, g.field, k) for g, k, to in refs if owner.get(to) not in g.targets}
    while True:
        new = {}
        for g, k, to in refs:
            if (g.table, g.field, k) not in direct and (owner[to], to) in level:
                new[g.table, k] = min(new.get((g.table, k), 10**9), level[owner[to], to] + 1)
        new = {x: n for x, n in new.items() if n < level.get(x, 10**9)}
        if not new:
            break
        level |= new
    want = sorted((g.table, g.field, k, 0 if (g.table, g.field, k) in direct else level[owner[to], to] + 1) for g, k, to in refs if (g.table, g.field, k) in direct or (owner[to], to) in level)
    got = orphan_cascade(frames, GRAPH, dict.fromkeys("abcd", "k"))
    assert rows(got, "ref_table", "ref_field", "row_key", "level") == want and max(w[3] for w in want) > 50


def test_replies_inherit_from_mails_of_unknown_senders(spark):
    t = tables(spark)
    t["email"] = t["email"].unionByName(spark.createDataFrame([("r1", "e2", "EMP_1", at(6), "x"), ("r2", "R1", "EMP_1", at(7), "x"), ("r3", "e1", "emp_9", at(7), "x")], t["email"].schema))
    got = [x for x in rows(orphan_cascade(t, THREAD_REFERENCES), "ref_table", "ref_field", "row_key", "kind", "level") if x[2] in ("r1", "r2", "r3")]
    assert got == [("email", "parent_id", "r1", "missing", 1), ("email", "parent_id", "r2", "missing", 2), ("email", "sender_id", "r3", "missing", 0)]
