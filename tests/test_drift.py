import itertools
import json
import random

from conftest import rows

from tidewrack.operators.drift import ADD, DELETE, MOVE, RENAME, edit_script, least_matching, schema_changes, schema_scripts, unified_table


def test_least_matching_is_least():
    r = random.Random(1)
    for _ in range(200):
        n, m = r.randint(1, 4), r.randint(4, 5)
        cost = [[r.randint(0, 9) for _ in range(m)] for _ in range(n)]
        got = sum(cost[i][j] for i, j in enumerate(least_matching(cost)))
        assert got == min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def cost_of(script, old, new, agree):
    """What a script of flat trees costs."""
    mapped = {a: b for _, a, b in script}
    at = lambda a, b: (MOVE if a[0] != b[0] else RENAME) + 0.2 / (1 + agree[a, b])
    gone, come = set(old) - set(new), set(new) - set(old)
    return sum(at(a, b) for a, b in mapped.items()) + DELETE * len(gone - mapped.keys()) + ADD * len(come - set(mapped.values()))


def test_edit_script_is_cheapest():
    r = random.Random(2)
    names = [(p, x) for p in ("meta", "raw") for x in "abcd"]
    chosen_among_several = 0
    for _ in range(300):
        old, new = {n for n in names if r.random() < 0.6}, {n for n in names if r.random() < 0.6}
        pairs = [(a, b) for a in sorted(old - new) for b in sorted(new - old) if r.random() < 0.6]
        agree = {p: r.randint(1, 9) for p in pairs}
        script = edit_script(sorted(old), sorted(new), agree)
        assert all((a, b) in agree and c == ("renamed" if a[0] == b[0] else "moved") for c, a, b in script)
        some = [m for k in range(len(pairs) + 1) for m in itertools.combinations(pairs, k) if len({a for a, _ in m}) == len({b for _, b in m}) == k]
        best = min(cost_of([("", a, b) for a, b in m], old, new, agree) for m in some)
        assert abs(cost_of(script, old, new, agree) - best) < 1e-9
        chosen_among_several += any(sum(x == a for x, _ in pairs) > 1 or sum(y == b for _, y in pairs) > 1 for _, a, b in script)
    assert chosen_among_several > 100


def nodes(*paths):
    """Paths like ``meta.a.b`` and all above them but the column."""
    return sorted({tuple(p.split(".")[:n]) for p in paths for n in range(2, p.count(".") + 2)})


def script(old, new, *agree):
    got = edit_script(nodes(*old), nodes(*new), {(tuple(a.split(".")), tuple(b.split("."))): n for a, b, n in agree})
    return {(c, ".".join(a), ".".join(b)) for c, a, b in got}


def test_scripts_of_nested_trees():
    # an object under another name with one leaf lost: its leaves stay with it
    assert script(["meta.user.id", "meta.user.mail", "meta.user.tz"], ["meta.sender.id", "meta.sender.mail"], ("meta.user.id", "meta.sender.id", 5), ("meta.user.mail", "meta.sender.mail", 5)) == {("renamed", "meta.user", "meta.sender"), ("kept", "meta.user.id", "meta.sender.id"), ("kept", "meta.user.mail", "meta.sender.mail")}
    # an object that went to another column, a leaf of it under another name
    assert script(["meta.geo.lat", "meta.geo.lon"], ["raw.geo.lat", "raw.geo.long"], ("meta.geo.lat", "raw.geo.lat", 3), ("meta.geo.lon", "raw.geo.long", 3)) == {("moved", "meta.geo", "raw.geo"), ("kept", "meta.geo.lat", "raw.geo.lat"), ("renamed", "meta.geo.lon", "raw.geo.long")}
    # a leaf that went into an object, and one that left it; the object itself is new
    assert script(["meta.a"], ["meta.box.a", "meta.box.b"], ("meta.a", "meta.box.a", 2)) == {("moved", "meta.a", "meta.box.a")}
    # two objects: whose leaves agree is who maps, whatever the names
    assert script(["meta.x.p.u", "meta.y.q.v"], ["meta.y2.q.v", "meta.x2.p.u"], ("meta.x.p.u", "meta.x2.p.u", 1), ("meta.y.q.v", "meta.y2.q.v", 1)) >= {("renamed", "meta.x", "meta.x2"), ("renamed", "meta.y", "meta.y2")}
    # a field with two partners goes where more records agree, and leaves the other to the field that has only that one
    assert script(["meta.a", "meta.b"], ["meta.c", "meta.d"], ("meta.a", "meta.c", 9), ("meta.a", "meta.d", 2), ("meta.b", "meta.c", 1)) == {("renamed", "meta.a", "meta.d"), ("renamed", "meta.b", "meta.c")}
    assert script(["meta.a"], ["meta.b"]) == set() and script([], ["meta.a.b.c"]) == set() and script(["meta.a"], ["meta.a"]) == set()


def test_nested_fields_of_files(spark):
    old = [("a", {"user": {"id": 1, "geo": {"lat": 5}}}, {}), ("b", {"user": {"id": 2, "geo": {"lat": 6}}}, {}), ("c", {"flag": True, "mark": True}, {})]
    new = [("A", {"sender": {"id": 1, "geo": {"lat": 5}}}, {}), ("b", {"sender": {"id": 2}}, {"lat": 6}), ("c", {"sign": True}, {})]
    x = lines(spark, {"s_10": old, "s_2": new})
    files = spark.createDataFrame(EXPORTS, "file_name string, feed string, stream string, file_no int")
    got = {(r.change, ".".join(r.old or []), ".".join(r.new or []), r.sole) for r in schema_scripts(x, files, depth=None).collect() if r.file_name == "s_2"}
    assert {("renamed", "meta.user", "meta.sender", False), ("kept", "meta.user.id", "meta.sender.id", True)} <= got
    flags = {g for g in got if "meta.flag" in g or "meta.mark" in g}
    assert flags == {("renamed", "meta.flag", "meta.sign", False), ("removed", "meta.mark", "", False)}  # the matching chose; the sole-partner rule would rename none
    assert ("meta.flag", "removed", "") in rows(schema_changes(x, files).where("file_name = 's_2'"), "field", "change", "new_field")
    assert schema_scripts(x.limit(0), files, depth=None).count() == 0


def lines(spark, files):
    out = [(f, i + 1, a, None if m is None else m if isinstance(m, str) else json.dumps(m), json.dumps(r), "x") for f, ls in files.items() for i, (a, m, r) in enumerate(ls)]
    return spark.createDataFrame(out, "file_name string, line_no int, artifact_id string, meta string, raw string, field string")


FILES = {
    "s_10": [("a", {"subject": "A", "n": 1}, {"k": 1}), (" B ", {"subject": "B", "n": 2}, {"k": 2})],
    "s_2": [("A", {"title": "A", "n": "1"}, {"k": 1}), ("b", {"title": "B", "n": None}, {"k": 2}), (None, [1], {}), ("z", "no json", {}), ("y", None, {})],
    "s_3": [("a", {"title": "A", "k": 1, "n": "1"}, {}), ("b", {"k": 2}, {"extra": True})],
    "s_4": [],
    "t_1": [("a", {"other": 1}, {})],
}
EXPORTS = [("s_10", "slack_01_clean", "s", 1), ("s_2", "slack_01_clean", "s", 2), ("s_3", "slack_01_clean", "s", 3), ("s_4", "slack_01_clean", "s", 4), ("t_1", "slack_01_clean", "t", 1), ("m", "messages", "s", 0)]


def test_changes_of_each_file(spark):
    x = lines(spark, FILES)
    files = spark.createDataFrame(EXPORTS, "file_name string, feed string, stream string, file_no int")
    got = rows(schema_changes(x.unionByName(x), files), "file_name", "field", "change", "new_field")
    assert got == sorted(
        [
            ("s_2", "meta.subject", "renamed", "meta.title"), ("s_2", "meta.n", "retyped", ""), ("s_3", "raw.k", "renamed", "meta.k"), ("s_3", "raw.extra", "added", ""),
            ("s_4", "meta.title", "removed", ""), ("s_4", "meta.k", "removed", ""), ("s_4", "meta.n", "removed", ""), ("s_4", "raw.extra", "removed", ""),
        ]
    )
    assert schema_changes(x.limit(0), files).count() == 0


def test_two_partners_are_none_and_values_must_agree(spark):
    x = lines(spark, {"f1": [("a", {"x": 1, "p": "1"}, {}), ("b", {"x": 1, "p": "2"}, {})], "f2": [("a", {"y": 1, "z": 1, "q": "1"}, {}), ("b", {"y": 1, "z": 1, "q": "9"}, {})]})
    files = spark.createDataFrame([("f1", "slack_01_clean", "s", 1), ("f2", "slack_01_clean", "s", 2)], "file_name string, feed string, stream string, file_no int")
    got = rows(schema_changes(x, files), "field", "change")
    assert got == [("meta.p", "removed"), ("meta.q", "added"), ("meta.x", "removed"), ("meta.y", "added"), ("meta.z", "added")]


def test_one_consistent_table(spark):
    files = spark.createDataFrame(EXPORTS[:3], "file_name string, feed string, stream string, file_no int")
    got = {(r.file_name, r.line_no): r.fields for r in unified_table(lines(spark, {k: v for k, v in FILES.items() if k in ("s_10", "s_2", "s_3")}), files).collect()}
    assert got["s_10", 1] == {"meta.title": '"A"', "meta.n": "1", "meta.k": "1"}
    assert got["s_2", 3] == {} and got["s_2", 4] == {} and got["s_2", 5] == {}
    assert got["s_3", 1] == {"meta.title": '"A"', "meta.k": "1", "meta.n": '"1"'}


def test_renames_chain_to_the_last_name(spark):
    x = lines(spark, {f"f{i}": [("a", {f"n{i}": 7}, {})] for i in range(1, 6)})
    files = spark.createDataFrame([(f"f{i}", "slack_01_clean", "s", i) for i in range(1, 6)], "file_name string, feed string, stream string, file_no int")
    assert {tuple(r.fields.items()) for r in unified_table(x, files).collect()} == {(("meta.n5", "7"),)}
