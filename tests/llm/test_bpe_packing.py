import random
from collections import Counter

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.llm import bpe
from tidewrack.llm.packing import pack, plan_containers


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P
    import tiktoken

    own = bpe.encoder(bpe.vocabulary_path())
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@given(st.text(max_size=60) | st.text(alphabet="ab éü😀\n\t'1", max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_public_encoder(both, text):
    own, public = both
    ids = own.encode(text)
    assert ids == public.encode_ordinary(text)
    assert own.decode(ids) == text


def test_long_and_special_texts(both):
    own, public = both
    for text in ("a" * 100_000, " " * 3000, "<|endoftext|>", "".join(map(chr, range(1, 3000))), "é" * 5000):
        assert own.encode(text) == public.encode_ordinary(text)
    assert own.encode(None) == own.encode("") == []


def test_columns(spark, both):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "hello world")], "doc_id int, text string")
    got = rows(df.select("doc_id", bpe.encode(F.col("text")).alias("ids"), bpe.token_count(F.col("text")).alias("n")))
    want = both[1].encode_ordinary("hello world")
    assert got == [(1, want, 2), (2, [], 0), (3, [], 0), (4, want, 2)]
    back = df.select("doc_id", bpe.decode(bpe.encode(F.col("text"))).alias("t"))
    assert rows(back) == [(1, "hello world"), (2, ""), (3, ""), (4, "hello world")]
    assert df.limit(0).select(bpe.encode(F.col("text"))).count() == 0


def best(sizes, capacity):
    """The least number of containers, by trying all."""
    sizes = sorted(sizes, reverse=True)
    least = [len(sizes)]

    def go(i, open_):
        if len(open_) >= least[0]:
            return
        if i == len(sizes):
            least[0] = len(open_)
            return
        for j in range(len(open_)):
            if open_[j] >= sizes[i] and open_[j] not in open_[:j]:
                go(i + 1, open_[:j] + [open_[j] - sizes[i]] + open_[j + 1 :])
        go(i + 1, [*open_, capacity - sizes[i]])

    go(0, [])
    return least[0]


def test_plan_holds_all_items_once_and_is_tight():
    r = random.Random(4)
    over = 0
    for _ in range(400):
        capacity = r.randint(1, 40)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 11))]
        plan = plan_containers(Counter(sizes), capacity)
        held = Counter()
        for contents, n in plan:
            assert sum(s * k for s, k in contents) <= capacity
            for s, k in contents:
                held[s] += k * n
        assert held == Counter(sizes)
        over += sum(n for _, n in plan) - best(sizes, capacity)
    assert over <= 12
    with pytest.raises(ValueError):
        plan_containers({5: 1}, 4)
    big = {s: r.randint(1, 10**9) for s in range(1, 2049)}
    used = sum(n for _, n in plan_containers(big, 2048))
    assert used <= 1.005 * sum(s * n for s, n in big.items()) / 2048 + 1


def test_pack(spark):
    sizes = [0, 0, None, 5, 10, 11, 25, 3, 3, 3, 3] + [4] * 200
    df = spark.createDataFrame([(i, s, 9) for i, s in enumerate(sizes)], "doc_id int, size int, container_id int")
    got = pack(df, "doc_id", "size", 10).collect()
    assert {r.doc_id for r in got} == set(range(len(sizes)))
    parts = {}
    room = Counter()
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.part_no, r.start_at, r.size))
        room[r.container_id] += r.size
    assert max(room.values()) <= 10 and sorted(parts[6]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and parts[4] == [(0, 0, 10)] and sorted(parts[5]) == [(0, 0, 10), (1, 10, 1)]
    assert all(len(p) == 1 for d, p in parts.items() if (sizes[d] or 0) <= 10)
    assert {r.container_id for r in got if r.size == 0} == {0}
    assert pack(df.limit(0), "doc_id", "size", 10).count() == 0
