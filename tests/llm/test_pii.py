import itertools
import math
import os
import random
import re

from conftest import rows

from tidewrack.llm import pii
from tidewrack.llm.pii import find_in, names_table, personal_information, redacted, trained_weights
from tidewrack.llm.pii_candidates import Candidate, Lexicon, fold, iban_end, luhn
from tidewrack.llm.pii_training import PATTERNS, annotated, examples
from tidewrack.llm.semicrf import best, links, marginals

DATA = "/root/testdata/sf0.01"


def test_programs_equal_enumeration():
    r = random.Random(6)
    text = "a b, c\nd; e f | g h " * 3
    for _ in range(200):
        segments = sorted((Candidate(a := r.randint(0, 40), a + r.randint(1, 9), r.choice("xy"), (f"f{i}",)) for i in range(r.randint(0, 6))), key=lambda c: (c.end, c.start))
        linked = links(text, segments)
        weights = {c.features[0]: r.uniform(-2, 2) for c in segments} | {f: r.uniform(-2, 2) for _, near in linked for f in near}
        feature = {(j, i): f for i, (far, near) in enumerate(linked) for j, f in enumerate(near, far)}
        total, mass, pairs, top = 0.0, dict.fromkeys(range(len(segments)), 0.0), dict.fromkeys(feature, 0.0), -math.inf
        for k in range(len(segments) + 1):
            for some in itertools.combinations(range(len(segments)), k):
                if all(segments[a].end <= segments[b].start for a, b in itertools.pairwise(some)):
                    steps = [p for p in itertools.pairwise(some) if p in feature]
                    score = sum(weights[segments[i].features[0]] for i in some) + sum(weights[feature[p]] for p in steps)
                    total, top = total + math.exp(score), max(top, score)
                    for i in some:
                        mass[i] += math.exp(score)
                    for p in steps:
                        pairs[p] += math.exp(score)
        single, double = marginals(segments, weights, linked)
        assert all(abs(mass[i] / total - p) < 1e-9 for i, p in enumerate(single))
        assert all(abs(pairs[j, i] / total - double[i][j - linked[i][0]]) < 1e-9 for j, i in pairs)
        chosen = [segments.index(c) for c in best(segments, weights, linked)]
        assert abs(sum(weights[segments[i].features[0]] for i in chosen) + sum(weights[feature[p]] for p in itertools.pairwise(chosen) if p in feature) - top) < 1e-9


def test_held_out_sentences():
    right = wrong = missed = 0
    for text, segments, gold in examples(seed=123):
        got, want = {(c.start, c.kind) for c in best(segments, trained_weights(), links(text, segments))}, {(c.start, c.kind) for c in gold}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.94 and right / (right + missed) > 0.94, (right, wrong, missed)
    assert len(annotated()) > 500


def test_wording_is_of_no_table(spark):
    """No three words of a training sentence stand together in the texts."""
    if not os.path.isdir(DATA):
        return
    word, runs = re.compile(r"\w+"), set()
    for p in PATTERNS:
        for piece in re.split(r"\{\w\}", p):
            words = word.findall(piece.lower())
            runs |= {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    for name in ("email", "messages"):
        for row in spark.read.parquet(f"{DATA}/{name}.parquet").where("text IS NOT NULL").select("text").collect():
            words = word.findall(row["text"].lower())
            assert not runs & {tuple(words[i : i + 3]) for i in range(len(words) - 2)}



LEX = Lexicon(frozenset({"greta", "ugo"}), frozenset({"zalmere", "kestrelle"}))
CASES = [
    ("Mail greta.z@loom.example, please", [("email", 5)]), ("mailto:g@x.test", [("email", 7)]), ("write to g_z (at) loom.example now", [("email", 9)]), ("g at loom dot example", [("email", 0)]),
    ("Ugo at the desk dot matrix printer", []), ("svc-roster@5.18.8 is out", []), ("ask @Ugo", []), ("call (617) 555-0113 now", [("phone", 5)]), ("ok (+1-617-555-0113)", [("phone", 4)]), ("(020 7946 0113)", [("phone", 1)]),
    ("order 573-6157785-37x is late", []), ("Attn: Greta Žalmere", [("name", 6)]), ("ŽALMERE, GRETA signed", [("name", 0)]), ("greta zalmere", [("name", 0)]), ("Greta B. Kestrelle's desk", [("name", 0)]), ("Greta can't start before Ugo", []),
    ("Ask Zorana Quillby about it", [("name", 4)]), ("the Harbor Lantern folder", []), ("at 190 Winterbourne Avenue today", [("address", 3)]), ("traffic on Winterbourne Avenue", []), ("Kesselweg 38b", [("address", 0)]), ("home: 99 bis, rue des Tilleuls", [("address", 6)]),
    ("Plaza Vidriera, 99", [("address", 0)]), ("Her passport is 42.733.522-4, ok", [("id_number", 16)]), ("asset 70.872.739-0 is back in stock", []), ("part number 958-67-0020 is on shelf 5", []), ("tax id 958-67-0020", [("id_number", 7)]),
    ("card 4539 1488 0343 6467 was charged", [("id_number", 5)]), ("card 4539 1488 0343 6468 was charged", []), ("IBAN GB82 WEST 1234 5698 7654 32 is new", [("id_number", 5)]), ("IBAN GB83 WEST 1234 5698 7654 32 is new", []), ("window 20260717 to 20260121", []),
]


def test_cases():
    wrong = [(t, want, [(c.kind, c.start) for c in find_in(t, trained_weights(), LEX)]) for t, want in CASES if [(c.kind, c.start) for c in find_in(t, trained_weights(), LEX)] != want]
    assert not wrong
    assert find_in(None, trained_weights(), LEX) == find_in("", trained_weights(), LEX) == []
    assert luhn("4539148803436467") and iban_end("GB82WEST12345698765432") == (22, True) and fold("Ž'Ø") == "zo"


def test_tables(spark):
    text = "😀 Attn: Greta Žalmere, g.z@loom.example"
    names = [f"{a}.{b}@x.example" for a in ("orsola", "petrus", "quillon", "radomir") for b in ("abelthorpe", "brockhurst", "cawdrey", "dunleath")]
    data = [("email", "1", text, 1), ("email", "1", text, 2), ("messages", "2", None, 1), ("messages", "3", "  ", 1), ("messages", "4", "x " * 100_000 + "greta zalmere", 1), ("messages", "5", "orsola cawdrey", 1)] + [("messages", f"m{i}", n, 1) for i, n in enumerate(names)]
    df = spark.createDataFrame(data, "src string, rec_id string, text string, kind int")
    people = spark.createDataFrame([("Greta Žalmere",), ("Mono",), (None,)], "name string")
    names = {r.word: (r.given, r.family) for r in names_table(people, df.where("text IS NOT NULL")).collect()}
    assert names["greta"] == (True, False) and names["zalmere"] == (False, True) and names["orsola"] == (True, True) and "mono" not in names
    got = [r for r in rows(personal_information(df, people), "src", "rec_id", "kind", "start_at") if not r[1].startswith("m")]
    assert got == [("email", "1", "email", 23), ("email", "1", "name", 8), ("messages", "4", "name", 200_000), ("messages", "5", "name", 0)]
    clean = {r.rec_id: r.text for r in redacted(df, people).collect()}
    assert clean["1"] == "😀 Attn: [NAME], [EMAIL]" and clean["2"] is None and clean["3"] == "  "
    assert personal_information(df.limit(0), people.limit(0)).count() == 0


def test_large_lexicon_goes_by_a_join(spark, monkeypatch):
    data = [("email", str(i), t) for i, t in enumerate(["greta žalmere", "Žalmere, Greta's desk", "greta van der zal rang", "ugo and greta", "", None, "GRETA\nZALMERE", "o'hara, mia"] * 2)]
    df = spark.createDataFrame(data, "src string, rec_id string, text string")
    people = spark.createDataFrame([("Greta Žalmere",), ("Greta van der Zal",), ("Mia O'Hara",)], "name string")
    whole = rows(personal_information(df, people), "src", "rec_id", "kind", "start_at"), rows(redacted(df, people), "rec_id", "text")
    monkeypatch.setattr(pii, "LEXICON", 0)
    assert (rows(personal_information(df, people), "src", "rec_id", "kind", "start_at"), rows(redacted(df, people), "rec_id", "text")) == whole
    assert len(whole[0]) == 6
