"""The kept topic store, ordered joins, folds and counts by ranges, streams that go on, and reports."""

import base64
import datetime as dt
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions import render
from tidewrack.operators import answers, asof, checks, conflicts, evidence, folds, graph, provider
from tidewrack.operators.topic_store import TopicStore
from tidewrack.sources import corpus
from tidewrack.streaming import incremental

READING = "topic string, status string, confidence string, owner string, blocker string, seen_at timestamp_ntz, seq bigint, source string, state_rank bigint"


def readings(spark, n, topics=("hot", "hot", "hot", "x", "y", None), seed=3):
    r = random.Random(seed)
    day = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(days=i)
    data = [(r.choice(topics), r.choice(["blocked", "on_track"]), r.choice(["high", "low"]), r.choice([None, "a", "b"]), r.choice([None, "p", "q"]), day(r.randrange(20)), i, "s", r.randrange(30)) for i in range(n)]
    return spark.createDataFrame(data, READING)


def folded(rs):
    """The state that folding one row after the other gives."""
    state = {}
    for r in sorted(rs, key=lambda r: r.seq):
        s = state.setdefault(r.topic, {"rank": None, "mentions": 0, "updates": -1, "owner": None, "first": r.seen_at, "last": r.seen_at})
        s["mentions"] += 1
        s["last"] = max(s["last"], r.seen_at)
        if s["rank"] is None or r.state_rank > s["rank"]:
            s |= {"rank": r.state_rank, "status": r.status, "confidence": r.confidence, "blocker": r.blocker, "owner": r.owner or s["owner"]}
            s["updates"] += 1
    return {(t, s["status"], s["confidence"], s["blocker"], s["owner"], s["mentions"], s["first"], s["last"], s["updates"]) for t, s in state.items()}


COLUMNS = ("topic", "status", "confidence", "blocker", "owner", "mentions", "first_seen", "last_seen", "updates")


def test_fold_by_ranges_equals_a_loop(spark):
    df = readings(spark, 700)
    assert set(rows(folds.topic_state(df, "topic", "state_rank", "seq"), *COLUMNS)) == folded(df.collect())
    assert folds.topic_state(df.limit(0), "topic", "state_rank", "seq").count() == 0


def test_batches_give_what_one_fold_gives(spark, tmp_path):
    df = readings(spark, 500, ("hot", "hot", "x", "y"))
    kept = TopicStore(spark, str(tmp_path / "topics"))
    assert kept.topics().count() == 0
    for lo, hi in ((0, 150), (150, 151), (151, 400), (400, 400), (400, 500)):
        kept.upsert(df.where(f"seq >= {lo} AND seq < {hi}"))
    assert set(rows(kept.topics(), *COLUMNS)) == folded(df.collect())
    kept.upsert(df.where("seq >= 400"), 4)  # a batch that is run again replaces its version
    assert set(rows(TopicStore(spark, str(tmp_path / "topics")).topics(), *COLUMNS)) == folded(df.collect())
    kept.set_embedded(spark.createDataFrame([("x", "text of x"), ("none", "t")], "topic string, text string"))
    assert rows(kept.topics(), "topic", "embedded_for") == [("hot", None), ("x", "text of x"), ("y", None)]
    assert rows(kept.upsert(df.where("seq = 3 AND topic = 'x'")), "topic", "embedded_for")[1] == ("x", "text of x")


def test_asof_previous_and_parts_equal_loops(spark):
    r = random.Random(1)
    left = [(r.choice(["h", "h", "k", None]), r.randrange(50), i, "l") for i in range(150)]
    right = [(r.choice(["h", "h", "k", None]), r.choice([None, *range(50)]), i, r.choice(["u", "v", None])) for i in range(150)]
    a, b = spark.createDataFrame(left, "k string, at int, id int, v string"), spark.createDataFrame(right, "k string, at int, id int, w string")
    want = []
    for k, at, i, _ in left:
        before = [(t, j, w) for kk, t, j, w in right if kk == k and t is not None and t <= at]
        want.append((i, max(before, key=lambda x: x[:2])[2] if before else None))
    assert rows(asof.asof_join(a, b, ["k"], "at", "at", ["w"], "id"), "id", "w") == sorted(want)
    got = dict(rows(asof.with_previous(a, ["k"], "id", ["at"]), "id", "previous_at"))
    for i, (k, _, n, _) in enumerate(left):
        assert got[n] == next((left[j][1] for j in range(i - 1, -1, -1) if left[j][0] == k), None)
    ranked = spark.range(1, 11).withColumnRenamed("id", "rank")
    assert [x[1] for x in rows(asof.ntiles(ranked, "rank", 4, 10, "part"), "rank", "part")] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert asof.asof_join(a.limit(0), b, ["k"], "at", "at", ["w"], "id").count() == 0


def test_most_within_equals_a_loop(spark):
    r = random.Random(2)
    data = [(r.choice(["u", "u", "w", None]), r.choice([None, r.randrange(900)])) for _ in range(400)]
    got = dict(rows(folds.most_within(spark.createDataFrame(data, "k string, at int"), "k", "at", 60), "k", "most"))
    assert got == {k: max(sum(kk == k and s is not None and t - 60 <= s <= t for kk, s in data) for k2, t in data if k2 == k and t is not None) for k in ("u", "w", None)}


def test_positions_count_opposing_claims_without_pairs(spark):
    r = random.Random(7)
    words = "a b c d e f g h".split()
    claims = [(r.choice(["S", "S", "t"]), i, " ".join(r.choices(words[: r.choice([3, 8])], k=r.randint(1, 6)))) for i in range(120)] + [("none", 500, None), ("none", 501, " ")]
    df = spark.createDataFrame([(s, i, c, "x", None, "blocked", "high") for s, i, c in claims], "topic string, seq int, blocker string, source string, owner string, status string, confidence string")
    by = {(s.lower(), c) for s, _, c in claims if c and c.strip()}
    want = set()
    for s, c in by:
        opposing = [o for t, o in by if t == s and o != c and len(set(o.split()) & set(c.split())) / max(len(set(o.split())), len(set(c.split()))) <= conflicts.LIKE]
        if opposing:
            want.add((s, c, len(opposing)))
    assert set(rows(conflicts.conflict_positions(df), "subject", "claim", "opposing")) == want


def test_streams_go_on_after_a_restart(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("v", T.StringType())])
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: rows(incremental.fold_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "at", "seq", ["v"], str(tmp_path / "base")), "k", "v", "mentions")
    put([("a", 5, 1, "new"), ("b", 1, 2, "b1")])
    assert run() == [("a", "new", 1), ("b", "b1", 1)]
    put([("a", 3, 3, "late"), ("b", 2, 4, "b2")])
    assert run() == [("a", "new", 2), ("b", "b2", 2)]
    assert run() == [("a", "new", 2), ("b", "b2", 2)]  # nothing new, nothing counted twice


def test_renderers_and_strict_evidence(spark):
    assert render.briefing([], []) == "*Briefing*\n\nNothing was reported." and render.tail_line({}) == ""
    shown = [{"topic": "t", "status": "blocked", "owner": None, "blocker": "b", "confidence": "low"}, {"topic": "u", "status": "on_track", "owner": "o", "blocker": None, "confidence": "high"}]
    text = render.briefing(shown, [{"status": "unclear", "n": 2}, {"status": "blocked", "n": 1}])
    assert text == "*Briefing*\n\n*Blocked*\n• *t* — b (no owner named) _[low confidence, needs confirmation]_\n\n*On track*\n• *u* (o)\n\n_Plus 3 more not detailed above: 1 blocked, 2 unclear._"
    assert render.split_answer("It is so.\n\nFound by:\n  a → b\n") == ("It is so.", ["a → b"]) and render.split_answer("x") == ("x", [])
    df = spark.createDataFrame([("a1", "c", ["s", "a1"], "hi", "t", "blocked", None, None, "2026-01-01", ["x [1]", "y [2]"])], "id string, c string, path array<string>, text string, topic string, status string, owner string, blocker string, seen string, ev array<string>")
    got = df.select(render.candidate_block(F.col("id"), F.col("c"), F.col("path"), F.col("text")).alias("a"), render.topic_block(F.col("topic"), F.col("status"), F.col("owner"), F.col("blocker"), F.col("seen"), F.col("ev")).alias("b")).head()
    assert got.a == "[a1] in c via s → a1\nhi" and got.b == "t | status: blocked | owner: unknown | blocker: none | last seen 2026-01-01\n  - x [1]\n  - y [2]"
    checked = spark.createDataFrame([("a", "s", "verified"), ("b", "t", "not_in_text")], "artifact_id string, span string, verdict string")
    assert evidence.assert_verified(checked.limit(0)).count() == 0
    with pytest.raises(ValueError, match="b: not_in_text"):
        evidence.assert_verified(checked)


def test_phrases_and_corpus_checks(spark):
    parts = spark.createDataFrame([("a1", "The billing-service of Ann Lee is down", None, "c"), ("a2", "annlee asked", "a1", "c"), ("a3", None, "a1", "c"), ("a4", "billing service down", "a1", "c")], "artifact_id string, text string, parent_id string, container_id string")
    entities = spark.createDataFrame([("E1", ["Ann Lee", None]), ("S1", ["billing service"]), ("N", [" "])], "entity string, terms array<string>")
    assert rows(graph.phrase_matches(parts, entities)) == [("a1", "E1"), ("a1", "S1"), ("a4", "S1")]
    assert graph.phrase_matches(parts, entities.limit(0)).count() == 0
    assert rows(checks.disjoint_steps(parts)) == [("c", 3, 2)]
    assert rows(checks.phrase_counts(parts.select("text"), ("DOWN", "never"))) == [("DOWN", 2), ("never", 0)]
    assert rows(checks.digests(parts, "container_id", ["text"])) == rows(checks.digests(parts.repartition(3), "container_id", ["text"]))


def test_refusals_and_batches(spark):
    kind = lambda *a: (r.kind, r.wait) if (r := provider.refusal_of(*a)) else None
    assert kind(429, "Please retry in 12.5s.") == ("rate", 12.5) and kind(429, "daily limit reached") == ("quota", 0.0) and kind(503, "try again in 2 minutes") == ("server", 120.0) and kind(400, "bad") is None
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}") for i in range(200)], "i int, t string").coalesce(1)
    got = dict(rows(df.select("i", provider.embedded_in_batches(F.col("t"), lambda ts: [[float(len(ts) <= 64), float(t[1:])] for t in ts]).alias("v"))))
    assert all(v == (None if i % 7 == 0 else [1.0, float(i)]) for i, v in got.items()) and len(got) == 200


def test_owners_synthesis_and_answers(spark, tmp_path):
    world = spark.createDataFrame([("employees", "EMP_1", "Ann", "EMP_9"), ("services", "svc-a", "pay engine", "EMP_1"), ("clients", "CUST_1", "pay corp", "EMP_2"), ("external", "CUST_1", "x", None)], "kind string, entity string, name string, owner string")
    owners = answers.world_owners(world)
    assert answers.referral(owners, "who owns the pay engine or pay corp?") == ("EMP_1", "Ann") and answers.referral(owners, "is Ann in?") == ("EMP_1", "Ann") and answers.referral(owners, "nothing") is None
    state = spark.createDataFrame([(f"t{i:02d}", "blocked" if i else "unclear", "high", None, None) for i in range(14)], "topic string, status string, confidence string, owner string, blocker string")
    assert answers.synthesized(state, lambda top: f"{len(top)} topics").startswith("12 topics\n\n_Plus 2 more") and answers.synthesized(state, lambda top: 1 / 0).startswith("*Briefing*\n\n*Blocked*") and "Nothing was reported" in answers.synthesized(state.limit(0))
    answers.write_answer(spark, answers.Answer("q", "so it is"), str(tmp_path / "answer"))
    assert [r.value for r in spark.read.text(str(tmp_path / "answer")).collect()] == ["so it is"]


def test_mail_dumps_and_two_files(spark, tmp_path):
    body = base64.urlsafe_b64encode(b"<b>Hi</b> all").decode().rstrip("=")
    mail = {"id": "m1", "internalDate": "1757271314000", "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "FROM", "value": "Ann <ann@x.test>"}], "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": body}}]}]}}
    (tmp_path / "mail.json").write_text(json.dumps({"messages": [mail, {"id": "no payload"}]}))
    (tmp_path / "chat.json").write_text(json.dumps([{"source": "slack", "user": "bo", "text": "yo", "ts": "1"}, {"source": "email", "text": "no"}]))
    got = rows(corpus.two_files(spark, str(tmp_path / "chat.json"), str(tmp_path / "mail.json")), "source", "sender", "timestamp", "text")
    assert got == [("email", "ann@x.test", "2025-09-07T18:55:14Z", "Hi all"), ("slack", "bo", "1", "yo")]
    (tmp_path / "s" / "history").mkdir(parents=True)
    (tmp_path / "s" / "users").mkdir()
    (tmp_path / "s" / "history" / "a.json").write_text('{"user": "U1", "ts": "1", "text": " hey "}\n{"user": "U1", "text": "joined", "subtype": "join"}\n')
    (tmp_path / "s" / "users" / "a.json").write_text('{"user": "U1", "name": "Bo"}\n')
    assert rows(corpus.ingest(spark, "slack", str(tmp_path / "s")), "sender", "text") == [("Bo", "hey")]
    key = spark.createDataFrame([("Q_1", "who?")], "question_id string, question string")
    assert corpus.asked_in(key, " q_1 ").count() == 1 and corpus.asked_in(key, "q").count() == 0
