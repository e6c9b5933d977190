import base64
import json
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.operators import checks, conflicts, evidence, folds, graph, provider, retrieval, store
from tidewrack.sources import connectors, corpus
from tidewrack.sources.mail import mail_records
from tidewrack.streaming import incremental


def test_folds_equal_a_sequential_fold(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "b", "c", None]), r.randint(0, 4), i, r.choice(["s", "t"]), r.choice(["high", "low"]), r.choice([None, "o1", "o2"]), r.choice([None, "x", "y"]), r.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(data, "topic string, rank bigint, seq bigint, status string, confidence string, owner string, blocker string, seen_at bigint").repartition(3)
    merged, state = {}, {}
    for k, rank, seq, s, c, o, b, at in data:
        m = merged.setdefault(k, {"rank": -1, "first": [None, None], "owner": None, "blocker": None, "n": 0})
        m["n"] += 1
        m["first"] = [m["first"][0] or o, m["first"][1] or b]
        t = state.setdefault(k, {"rank": -1, "owner": None, "n": 0, "updates": -1, "first": at, "last": at})
        t["n"], t["last"] = t["n"] + 1, max(t["last"], at)
        if rank > m["rank"]:
            m.update(rank=rank, s=s, c=c, owner=o or m["owner"], blocker=b or m["blocker"])
            t.update(rank=rank, s=s, c=c, b=b, owner=o or t["owner"], updates=t["updates"] + 1)
    got = rows(folds.merge_items(df, "topic", "rank", "seq"), "topic", "status", "confidence", "owner", "blocker", "readings")
    assert set(got) == {(k, m["s"], m["c"], m["owner"] or m["first"][0], m["blocker"] or m["first"][1], m["n"]) for k, m in merged.items()}
    got = rows(folds.topic_state(df, "topic", "rank", "seq"), "topic", "status", "confidence", "blocker", "owner", "mentions", "first_seen", "last_seen", "updates")
    assert set(got) == {(k, t["s"], t["c"], t["b"], t["owner"], t["n"], t["first"], t["last"], t["updates"]) for k, t in state.items()}
    assert folds.topic_state(df.limit(0), "topic", "rank", "seq").count() == 0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head()["x"]
    assert one(X.tokens(F.lit("The Don't-stop v2, éabc AND Quote'"))) == ["don't-stop", "v2", "quote"]
    assert one(X.tokens(F.lit(None).cast("string"))) == []
    assert one(X.aliases(F.lit("See ENG-44, pr #9 and a.b@c.org; v2"))) == sorted(["eng-44", "a.b@c.org", "v2"])
    assert one(X.topic_key(F.lit("The Billing-Migration, project!"))) == "billing migration"
    assert one(X.topic_key(F.lit(" The Team "))) == "the team"
    assert one(X.citations(F.lit("x [a1, b2; a1] y [bad id] [c_3]"))) == ["a1", "b2", "c_3"]
    assert one(X.html_text(F.lit("<p>a&nbsp;&amp;  b</p>"))) == " a & b "
    assert one(X.without_history(F.lit("Yes.\n> old\nOn Mon someone wrote:\n> x"))) == "Yes."
    assert one(X.without_history(F.lit("Yes.\r\n-- \r\nme"))) == "Yes."
    assert one(X.base64url_text(F.lit(base64.urlsafe_b64encode("ü>?ÿ".encode()).decode().rstrip("=")))) == "ü>?ÿ"
    assert one(X.message_id(F.lit(" id "), F.lit("s"), F.lit(None).cast("string"), F.lit("t"), F.lit("x"))) == "id"
    assert len(one(X.message_id(F.lit(None).cast("string"), F.lit("s"), F.lit(None).cast("string"), F.lit("t"), F.lit("x")))) == 16


def test_bm25_and_keywords_against_plain_code(spark):
    texts = ["retry logic retry", "nothing here", "the retry", None, "", "logic " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    toks = [[w for w in (t or "").lower().split() if w not in X.STOP_WORDS] for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    want = {}
    for i, t in enumerate(toks):
        s = 0.0
        for q in ("retry", "logic", "retry"):
            n = sum(q in u for u in toks)
            tf = t.count(q)
            s += max(0, np.log((len(toks) - n + 0.5) / (n + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if any(q in t for q in ("retry", "logic")):
            want[i] = s
    got = dict(rows(retrieval.bm25(df, "id", "text", "Retry the logic, retry!")))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert retrieval.bm25(df.limit(0), "id", "text", "retry").count() == 0 and retrieval.bm25(df, "id", "text", "the of").count() == 0
    assert rows(retrieval.keyword_score(df, "id", "text", ["RETRY", "logic"])) == [(0, 1.0), (2, 0.5), (5, 0.5)]
    assert dict(rows(retrieval.document_frequency(df, "id", "text")))["retry"] == 2


def test_cosine_is_exact_in_blocks(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(90, 8))
    v[7] = v[3]
    v[9] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(90)] + [(99, None)], "id bigint, e array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    got = {}
    for q, i, s in rows(retrieval.cosine_top(df.where("id % 20 = 0"), df, "id", "e", 4, block=2), "query_id", "id", "score"):
        got.setdefault(q, []).append((-s, i))
    for q in range(0, 90, 20):
        want = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(90) if i != q)[:4]
        assert sorted(got[q]) == want


def test_cosine_never_groups_rows_and_ranks_by_the_rounded_score(spark):
    near = [[1.0, 0.0], [1.0, 2e-4], [1.0, 1e-4], [1.0, 1.0]]
    df = spark.createDataFrame([*enumerate(near)], "id bigint, e array<double>").coalesce(1)
    found = retrieval.cosine_top(df.where("id = 0"), df, "id", "e", 1)
    assert rows(found, "query_id", "id", "score") == [(0, 1, 1.0)]
    assert "collect_list" not in found._jdf.queryExecution().toString()
    r = np.random.default_rng(6).normal(size=(3000, 4))
    many = spark.createDataFrame([(i, [float(x) for x in r[i]]) for i in range(3000)], "id bigint, e array<double>").repartition(3)
    unit = r / np.linalg.norm(r, axis=1, keepdims=True)
    got = rows(retrieval.cosine_top(many.where("id < 2"), many, "id", "e", 5), "query_id", "score", "id")
    want = [sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(3000) if i != q)[:5] for q in range(2)]
    assert got == sorted((q, -s, i) for q in range(2) for s, i in want[q])
    assert retrieval.cosine_top(many.where("id < 0"), many, "id", "e", 5).count() == 0


def artifacts(spark):
    data = [("a1", "slack", "c1", None, "E1", ["E2"], "retry is blocked", 0), ("a2", "slack", "c1", "a1", "E2", [], "eng-44 waits", 3600), ("a3", "email", "c2", None, "E3", None, "see ENG-44", 7200), ("a4", "email", "c3", "zz", "E9", [], "", None), ("a5", "slack", None, None, "E1", [], None, 18000)]
    return spark.createDataFrame(data, "artifact_id string, source string, container_id string, parent_id string, sender_id string, recipients array<string>, text string, s int").withColumn("ts", F.timestamp_seconds("s"))


def test_graph_hops_and_checks(spark):
    parts = artifacts(spark)
    links = graph.artifact_entities(parts, graph.alias_table(spark.createDataFrame([("E3", ["Ann Lee", "ann"])], "entity string, terms array<string>")))
    seeds = parts.where("artifact_id = 'a1'")
    got = {r.artifact_id: (r.hop, r.path) for r in graph.retrieve(seeds, parts, links).collect()}
    assert got["a1"] == (0, ["a1"]) and got["a2"] == (1, ["a1", "a2"]) and got["a5"][0] == 1 and got["a3"] == (2, ["a1", "a2", "a3"]) and "a4" not in got
    assert rows(graph.time_neighbours(seeds.select("artifact_id"), parts, links)) == [("a1", "a2"), ("a1", "a5")]
    assert rows(checks.dangling_parents(parts)) == [("a4", "zz")]
    assert rows(checks.unknown_senders(parts, spark.createDataFrame([("e1",), ("E2 ",), ("e3",)], "person_id string"))) == [("E9", 1)]
    assert rows(checks.unanswered(parts)) == [("a3", "c2")]
    reasons = [r.r for r in parts.select(checks.artifact_reason().alias("r")).collect()]
    assert reasons == [None, None, None, "ts", "container_id"]


def test_entities_are_found_inside_hyphenated_words(spark):
    texts = ["svc-bill-v2 fails", "Anna Meyer-Lee called", "Lee's turn", "re-svc-bill's log", "svc-billing", "a_lee or éLee", "o'lee--lee", "svc--bill", None]
    parts = spark.createDataFrame([(str(i), t, None, None, []) for i, t in enumerate(texts)], "artifact_id string, text string, container_id string, sender_id string, recipients array<string>")
    table = graph.alias_table(spark.createDataFrame([("S1", ["svc-bill"]), ("E1", ["Lee"])], "entity string, terms array<string>"))
    assert rows(graph.artifact_entities(parts, table).where("entity IN ('S1', 'E1')"), "artifact_id", "entity") == [("0", "S1"), ("1", "E1"), ("2", "E1"), ("3", "S1"), ("6", "E1")]


def test_retrieval_takes_alias_seeds_and_closes_over_aliases(spark):
    data = [("b1", "slack", "c1", "E1", "the retry waits", 0), ("b2", "email", "c2", "E2", "pay-7 is late", 0), ("b3", "email", "c3", "E3", "after PAY-7", 0), ("b4", "email", "c4", "E4", "see OPS-9", 0), ("b5", "email", "c5", "E5", "ops-9 done", 0), ("b6", "email", "c6", "E6", "lunch", 0)]
    parts = spark.createDataFrame([(i, s, c, None, p, [], t, at) for i, s, c, p, t, at in data], "artifact_id string, source string, container_id string, parent_id string, sender_id string, recipients array<string>, text string, s int").withColumn("ts", F.timestamp_seconds("s"))
    table = graph.alias_table(spark.createDataFrame([("E4", ["Ann"])], "entity string, terms array<string>"))
    links, keys = graph.artifact_entities(parts, table), graph.alias_keys(parts)
    question = "retry of pay-7 by Ann"
    ranked = retrieval.bm25(parts, "artifact_id", "text", question)
    assert {r.artifact_id for r in graph.seeds(question, ranked, parts, links, table, keys).collect()} == {"b1", "b2", "b3", "b4"}
    mails = parts.where("source = 'email'")
    assert {r.artifact_id for r in graph.seeds(question, ranked, mails, links, table, keys).collect()} == {"b2", "b3", "b4"}
    got = graph.retrieve(parts.where("artifact_id IN ('b1', 'b4')"), parts, links.where("false"), question=question).collect()
    assert [(r.artifact_id, r.hop, r.path) for r in got] == [("b4", 0, ["b4"]), ("b2", 0, ["b2"]), ("b3", 0, ["b3"]), ("b5", 1, ["b4", "b5"]), ("b1", 0, ["b1"])]


def test_items_answers_and_conflicts(spark):
    good = {"source": "s", "topic": "t", "status": "blocked", "confidence": "low", "evidence": [{"artifact_id": "a", "span": "x"}]}
    cases = [(good, None), ({**good, "x": 1}, "unknown field"), ({k: v for k, v in good.items() if k != "topic"}, "missing field"), ({**good, "status": "fine"}, "status"), ({**good, "evidence": []}, "evidence"), ({**good, "topic": " "}, "topic"), ([1], "not an object")]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "{")], "i int, j string").select("i", checks.item_reason(F.col("j")).alias("r"))
    assert rows(df) == [(i, r) for i, (_, r) in enumerate(cases)] + [(99, "not an object")]
    df = spark.createDataFrame([(1, "T", 1, "waits for a", "s", None, "blocked", "low"), (2, "t", 2, "money is short", "s", None, "at_risk", "high"), (3, "t", 3, "Waits  for A", "s", None, "blocked", "low"), (4, "t", 4, "", "s", None, "blocked", "low"), (5, "t", 5, None, "s", None, "blocked", "low")], "id int, topic string, seq int, blocker string, source string, owner string, status string, confidence string")
    assert rows(conflicts.conflicts(df), "subject", "seq_a", "seq_b", "winner") == [("t", 1, 2, 2)]
    a = spark.createDataFrame([(True, [], [], []), (True, [], [], ["Ann"]), (False, [], ["a"], []), (False, ["b"], ["a"], []), (False, ["a"], ["a"], [])], "ab boolean, c array<string>, k array<string>, w array<string>")
    assert [r.x for r in a.select(checks.answer_reason(F.col("ab"), F.col("c"), F.col("k"), F.col("w")).alias("x")).collect()] == ["names nobody", None, "cites nothing", "cites unknown ids", None]


def test_evidence_and_store(spark):
    e = spark.createDataFrame([("v1", "t", " A1", "is  blocked"), ("v2", "t", "a1", "is fine"), ("v3", "u", "none", "x"), ("v4", "u", "a1", " ")], "evidence_id string, topic_key string, artifact_id string, span string")
    checked = evidence.checked_evidence(e, artifacts(spark))
    assert rows(checked, "evidence_id", "verdict") == [("v1", "verified"), ("v2", "not_in_text"), ("v3", "no_artifact"), ("v4", "empty")]
    assert rows(evidence.dropped_topics(checked)) == [("u", 2)]
    old = spark.createDataFrame([("m1", 1)], "id string, at int")
    new = spark.createDataFrame([("m1", 2), ("m2", 3), ("m2", 2), (None, 1)], "id string, at int")
    assert rows(store.new_rows(new, old, "id", ["at"])) == [("m2", 2)]
    x = spark.createDataFrame([("a", "x", None), ("b", "x", "x"), ("c", None, None)], "topic string, text string, embedded_for string")
    assert rows(store.stale_embeddings(x), "topic") == [("a",)]


def test_provider_isolates_a_failed_chunk(spark):
    def flaky(messages):
        if any(m["text"] == "boom" for m in messages):
            raise RuntimeError("no quota")
        return provider.offline_extract(messages)

    df = spark.createDataFrame([("1", "It is blocked. Fine."), ("2", "boom"), ("3", None)], "id string, text string").coalesce(1)
    assert rows(provider.extract_in_chunks(df, 1, flaky), "artifact_id", "status", "span", "error") == [("1", "blocked", "It is blocked.", None), (None, None, None, "RuntimeError: no quota")]
    v = [r.v for r in df.select(provider.hashed_embedding(F.col("text"), 16).alias("v")).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-5 and sum(map(abs, v[2])) == 0


def test_mail_dump(spark):
    b64 = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    part = "mimeType string, headers array<struct<name:string,value:string>>, body struct<size:bigint,data:string>"
    schema = f"id string, snippet string, internalDate string, payload struct<{part.replace(' ', ':', 1).replace(', headers ', ', headers:').replace(', body ', ', body:')}, parts:array<struct<mimeType:string, body:struct<data:string>, parts:array<struct<mimeType:string, body:struct<data:string>>>>>>"
    data = [
        ("1", "s", "1757271314000", ("multipart/mixed", [("from", "Ann <ann@x.org>"), ("SUBJECT", "Hi")], (0, None), [("multipart/alternative", (None,), [("text/html", (b64("<b>no</b>"),)), ("text/plain", (b64("Yes.\n> old\n"),))])])),
        ("2", " snip ", None, ("text/html", [("From", "bob"), ("Date", "Thu, 1 Jan 2026 00:00:00 +0000")], (3, b64("<p>a &amp; b</p>")), None)), ("3", " snip ", None, ("text/plain", None, (0, None), None)), ("4", "", None, ("text/plain", [], (0, None), None)),
    ]
    got = rows(mail_records(spark.createDataFrame(data, schema)), "id", "sender", "epoch_ms", "text")
    assert got == [("1", "ann@x.org", 1757271314000, "Subject: Hi\n\nYes."), ("2", "bob", 1767225600000, "a & b"), ("3", "unknown", None, "snip")]


def test_corpus_fixtures_world_and_connectors(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "slack_02.jsonl").write_text('﻿{"artifact_id": "a", "ts": "1757271314.5", "recipients": "r", "text": "x"}\n\n{"artifact_id": "a"}\nnot json\n[1]\n{"text": "t"}\n{"artifact_id": 5, "source": "fax", "recipients": null, "ts": "soon"}', encoding="utf-8")
    good, failed = corpus.load_corpus(spark, str(tmp_path / "c"))
    assert rows(good, "artifact_id", "source", "epoch_ms", "text") == [("5", "fax", None, ""), ("a", "slack", 1757271314500, "x")]
    assert [r[1:] for r in rows(failed)] == [(3, "duplicate of slack_02.jsonl:1"), (4, "bad_json"), (5, "not_object"), (6, "no_id")]
    warned = {r.artifact_id: r.warnings for r in good.collect()}
    assert warned["5"] == ["unknown source", "no text", "ts unreadable"] and warned["a"] == ["source from file name", "recipients no list"]
    assert {r.artifact_id: r.raw for r in good.collect()}["5"].startswith('{"artifact_id": 5') and {r.meta for r in good.collect()} == {None}
    assert rows(corpus.corpus_messages(good), "artifact_id", "text") == [("a", "x")]
    with pytest.raises(ValueError, match="slack_02.jsonl"):
        corpus.load_strictly(spark, str(tmp_path / "c"))
    wrapped = spark.createDataFrame([("slack_1.jsonl", 1, '{"artifact_id": "a", "meta": "m", "raw": {"k": 1}}')], "file_name string, line_no int, line string")
    assert rows(corpus.artifacts_of(wrapped), "meta", "raw") == [('{"value":"m"}', '{"k":1}')]
    (tmp_path / "k.json").write_text('{"questions": [{"question_id": "Q1", "question": "q?", "gold_artifacts": ["a", "b"]}]}')
    assert rows(corpus.read_answer_key(spark, str(tmp_path / "k.json"))) == [("Q1", "q?", ["a", "b"])]
    assert [r.m for r in spark.createDataFrame([('{"payload": {}}',), ("{}",), ("x",)], "j string").select(corpus.is_mail(F.col("j")).alias("m")).collect()] == [True, False, False]
    (tmp_path / "m.json").write_text('{"messages": [{"user": "u", "body": " hi ", "date": "d"}, {"from": "", "text": " "}, {"content": "y", "source": "email"}]}')
    assert rows(corpus.ingest(spark, "fixtures", str(tmp_path / "m.json"))) == [("email", "unknown", "", "y"), ("slack", "u", "d", "hi")]
    with pytest.raises(ValueError):
        corpus.ingest(spark, "fax", "x")
    (tmp_path / "w.json").write_text('{"employees": [{"employee_id": "E1", "name": "Ann", "manager_id": null, "aliases": ["an"], "team": "ops"}], "services": [{"service_id": "S1", "name": "pay", "owner_id": "E1"}]}')
    assert rows(corpus.read_world(spark, str(tmp_path / "w.json")), "kind", "entity", "owner", "terms") == [("employees", "E1", None, ["an", "Ann", "ops"]), ("services", "S1", "E1", ["pay"])]
    spark.dataSource.register(connectors.channel_source(lambda page: [(f"U{page}", "1", " hello ", None), ("U9", "2", "joined", "join")], 2))
    users = spark.createDataFrame([("U0", "Ann")], "user string, name string")
    assert rows(connectors.channel_messages(spark.read.format("channel").load(), users), "sender", "text") == [("Ann", "hello"), ("U1", "hello")]
    sent = []
    assert connectors.deliver("x", sent.append) == "posted" and connectors.deliver("x", sent.append, dry_run=True) == "console" and sent == ["x"]
    connectors.write_jsonl(good.select("artifact_id", "source"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_streams(spark, tmp_path):
    a = spark.createDataFrame([("m1", "t", 3, 1), ("m2", "t", 5, 2), ("m1", "t", 3, 3)], "id string, topic string, rank bigint, seq bigint")
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: incremental.table_stream(spark, str(tmp_path / "in"), a.schema)
    assert rows(incremental.run_once(stream().dropDuplicates(["id"]).select("id"))) == [("m1",), ("m2",)]
    spark.createDataFrame([("m4", "t", 1, 4), ("m5", "u", 1, 5)], a.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folded = incremental.fold_batches(spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "topic", "rank", "seq", ["id"])
    assert rows(folded) == [("t", "m2", 4), ("u", "m5", 1)]
    timed = stream().withColumn("at", F.timestamp_seconds(F.col("seq") * 60))
    assert incremental.deduplicated(timed, "id", "at", "1 hour").isStreaming and incremental.windowed_counts(timed, "at", "topic", "5 minutes", "1 hour").isStreaming


def test_answers(spark):
    from tidewrack.operators.answers import answer, check_question, last_turns

    items = spark.createDataFrame([("Retry logic", "blocked", "high", "Ann", "no keys", "a1"), ("Billing", "on_track", "low", None, None, "a2")], "topic string, status string, confidence string, owner string, blocker string, artifact_id string")
    found = spark.createDataFrame([("a1", ["a0", "a1"], "slack", "c1", "x"), ("a3", ["a3"], "email", None, "y")], "artifact_id string, path array<string>, source string, container_id string, text string")
    owners = spark.createDataFrame([("S1", "Billing service", "E1", "Bo", 4), ("C1", "Billing client", "E2", "Cy", 2)], "entity string, name string, owner string, owner_name string, weight int")
    a = answer("what blocks the retry?", items, found, owners)
    assert a.text == "Retry logic is blocked because no keys; Ann is responsible [a1]." and a.cited == ["a1"] and not a.abstained
    b = answer("who runs billing?", items, found, owners)
    assert b.abstained and b.who_would_know == ["E1"] and "Bo would know" in b.text
    c = answer("retry?", items, found, owners, lambda q, xs: f"It waits [{xs[1]['artifact_id']}].")
    assert c.cited == ["a1"] and "a0 → a1   (slack · c1 · 1 hop)" in c.text
    assert answer("retry?", items, found, owners, lambda q, xs: "made up [zz]").cited == ["a1"]
    assert answer("retry?", items, found, owners, lambda q, xs: None).abstained
    assert answer("xyzzy", items, found, owners.limit(0)).text.endswith("No owner is known.")
    for bad in ("", "x" * 501):
        with pytest.raises(ValueError):
            check_question(bad)
    turns = spark.createDataFrame([(i, "user", f"t{i}") for i in range(12)], "seq int, role string, text string")
    assert [t["seq"] for t in last_turns(turns)] == list(range(4, 12))


def test_provider_chain_limit_and_json():
    waits, calls = [], []

    def down(request):
        calls.append("down")
        raise provider.Unavailable("quota")

    def slow(request, state=[0]):
        calls.append("slow")
        state[0] += 1
        if state[0] < 3:
            raise provider.Unavailable("rate", 7.0)
        return request

    assert provider.chained([down, slow], pause=waits.append)("x") == "x" and calls == ["down", "slow", "slow", "slow"] and waits == [7.0, 7.0]
    with pytest.raises(provider.Unavailable):
        provider.chained([down], pause=waits.append)("x")
    now = [0.0]
    limit = provider.RateLimit(2, 60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        limit.wait()
    assert now[0] == 120.0
    assert provider.json_of('```json\n{"a": 1}\n```') == {"a": 1} and provider.json_of('Sure: {"a": "}"} done') == {"a": "}"} and provider.json_of("[1]") == [1]
    with pytest.raises(ValueError):
        provider.json_of("none { here")
