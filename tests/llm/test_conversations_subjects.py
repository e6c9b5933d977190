import datetime as dt
import random

import numpy as np
from conftest import rows

from tidewrack.llm.conversations import conversations, fold_versions, rooted
from tidewrack.llm.subjects import Settings, calibrate, complement_weights, statements, subject_areas


def mails(spark, data):
    out = [(a, c, p, s, ts, t, dt.datetime(2026, 1, 1) + dt.timedelta(hours=h), 1) for a, c, p, s, ts, t, h in data]
    return spark.createDataFrame(out, "artifact_id string, container_id string, parent_id string, sender_id string, ts string, text string, loaded_at timestamp_ntz, turn_no int")


T = "2026-01-01T0{}:00:00{}"


def test_threads(spark):
    data = [
        ("a1", "c1", None, "E1", T.format(1, "Z"), "hello", 1), ("a2", "C1 ", "A1", "e2 ", T.format(3, "+01:00"), "yes", 1), ("a3", "c1", "a2", "BOT_X", T.format(2, "Z"), "beep", 1), ("a4", "c1", "a1", None, T.format(4, "Z"), "who", 1), ("a5", "c1", "a3", "E1", T.format(5, "Z"), " ", 1),
        ("a1", "c1", None, "E1", T.format(2, "+01:00"), "hello", 9),  # delivered again with another offset
        ("b1", "two roots", None, "E1", T.format(1, "Z"), "x", 1), ("b2", "two roots", None, "E2", T.format(1, "Z"), "x", 1), ("d1", "gap", None, "E1", T.format(1, "Z"), "x", 1), ("d2", "gap", "a1", "E2", T.format(1, "Z"), "x", 1),
        ("e1", "cycle", None, "E1", T.format(1, "Z"), "x", 1), ("e2", "cycle", "e3", "E2", T.format(1, "Z"), "x", 1), ("e3", "cycle", "e2", "E2", T.format(1, "Z"), "x", 1), ("f1", "no time", None, "E1", None, "x", 1), ("f2", "no time", "f1", "E2", T.format(1, "Z"), "x", 1),
        ("g1", "unanswered", None, "E1", T.format(1, "Z"), "x", 1), ("g2", "unanswered", "g1", "E1", T.format(2, "Z"), "x", 1), ("h1", "bot opens", None, "BOT_1", T.format(1, "Z"), "x", 1), ("h2", "bot opens", "h1", "E2", T.format(2, "Z"), "x", 1),
        ("i1", "silent opener", None, "E1", T.format(1, "Z"), "", 1), ("i2", "silent opener", "i1", "E2", T.format(2, "Z"), "x", 1), (None, "c1", None, "E1", T.format(1, "Z"), "x", 1), ("j1", None, None, "E1", T.format(1, "Z"), "x", 1), ("k1", "bad time", None, "E1", "soon", "x", 1),
    ]
    x = mails(spark, data)
    got = rows(conversations(x), "container_id", "turn_no", "artifact_id", "speaker")
    assert got == [("C1", 2, "a2", "replier"), ("c1", 1, "a1", "opener"), ("c1", 3, "a3", "system"), ("c1", 4, "a4", "unknown")] or [r[1:] for r in sorted(got, key=lambda r: r[1])] == [(1, "a1", "opener"), (2, "a2", "replier"), (3, "a3", "system"), (4, "a4", "unknown")]
    assert fold_versions(x).where("a = 'a1'").count() == 1
    assert conversations(x.limit(0)).count() == 0


def test_reachability_equals_walking_up(spark):
    r = random.Random(8)
    parent = {}
    for c in range(12):
        n = 40
        for i in range(n):
            parent[(f"c{c}", f"m{i}")] = None if i == 0 else f"m{i - 1 if c % 3 == 0 else r.randrange(n if c % 2 else i)}"
    lost = set()
    for c, m in parent:
        seen, at = set(), m
        while at is not None and at not in seen:
            seen.add(at)
            at = parent[(c, at)]
        if at is not None:
            lost.add((c, m))
    df = spark.createDataFrame([(c, m, p) for (c, m), p in parent.items()], "c string, a string, p string")
    assert set(rows(rooted(df))) == lost and lost


def test_statements_and_model_parts():
    assert statements("- One two.\n> Three four! five\n\n") == [["one", "two"], ["three", "four"], ["five"]]
    assert statements(None) == statements("  \n .") == [] and [len(s) for s in statements("w " * 50)] == [13, 13, 13, 11]
    w = complement_weights(np.array([[8.0, 0, 0], [0, 8, 0], [1, 1, 1]]), 0.1)
    assert w[0].argmax() == 0 and w[1].argmax() == 1
    share = np.array([[0.0, 0.9], [0.8, 0.0], [0.1, 0.9], [0.9, 0.1]] * 20)
    slope, offset = calibrate(share, (share > 0.5).astype(float))
    p = 1 / (1 + np.exp(-(slope * np.log((share + 0.02) / (1.02 - share)) + offset)))
    assert ((p > 0.5) == (share > 0.5)).all()


WORDS = {"sport": "goal match runner stadium coach team", "law": "court clause judge appeal contract lawyer", "none": "hello thanks later lunch morning bye"}


def test_areas_of_held_out_documents(spark):
    r = random.Random(9)
    say = lambda a: " ".join(r.choice(WORDS[a].split()) for _ in range(5)) + "."
    docs, truth = [], {}
    for i in range(240):
        areas = r.choice([["sport"], ["law"], ["sport", "law"], []])
        text = [say(a) for a in areas for _ in range(4)] + [say("none") for _ in range(2 if areas else 5)]
        r.shuffle(text)
        docs.append((i, " ".join(text), "x"))
        truth[i] = set(areas)
    docs += [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (903, "1234 ==", "x"), (904, "goal match coach. " * 20_000, "x"), (1, docs[1][1], "x")]
    labels = [(i, s, a, None) for i in range(0, 240, 4) for s in (truth[i] or {"none"}) for a in ("p", "q")] + [(5000, "law", "p", None), (0, None, "p", None), (0, "unknown", "p", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    areas = spark.createDataFrame([("sport", "d"), ("law", "d"), (None, "d")], "subject string, description string")
    given = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string, labelled_at timestamp_ntz")
    small = Settings(buckets=1 << 12)
    got = {}
    for d, s in rows(subject_areas(df, areas, given, small), "doc_id", "subject"):
        got.setdefault(d, set()).add(s)
    held = [i for i in range(240) if i % 4]
    assert sum(got.get(i, set()) == truth[i] for i in held) / len(held) > 0.95
    assert got[904] == {"sport"} and not {900, 901, 902, 903} & got.keys()
    assert subject_areas(df.limit(0), areas, given, small).count() == 0
    assert subject_areas(df, areas, given.limit(0), small).count() == 0
