"""Items of varying length into containers of fixed capacity, none split that fits.

Only the histogram of sizes matters for a packing, and it has at most as many rows as the capacity. So Spark counts
the sizes, the driver plans containers for the counts (never for single items), and Spark hands each item its place
by its rank within its size.

The plan is by large-item matching. Items above a third of the capacity fit at most twice in a container, so they are
matched: from the largest on, each takes the largest partner above a third that fits it. The smaller items then go,
largest first, to the container whose gap is the least that holds them (best fit); what fits nowhere opens new ones.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.ranking import rank_within
from tidewrack.session import materialize


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(contents, how many containers have them) for a histogram {size: items}; contents are ((size, items), ...).

    Containers alike are planned together: every step places as many equal items into equal containers as there
    are, so the work follows the number of distinct sizes and contents, not that of items.
    """
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("sizes must lie in 1..capacity")
    open_: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))  # gap: {contents: containers}
    large = {s: n for s, n in histogram.items() if s * 3 > capacity and n}
    sizes = sorted(large)
    while sizes:
        s = sizes[-1]
        n = large[s]
        k = bisect_left(sizes, capacity - s + 1) - 1  # the largest that fits beside s
        if k < 0:
            open_[capacity - s][((s, 1),)] += n
            sizes.pop()
        elif (t := sizes[k]) == s:
            if n > 1:
                open_[capacity - 2 * s][((s, 2),)] += n // 2
            large[s] = n % 2
            if n % 2:
                sizes.pop()
                k = bisect_left(sizes, capacity - s + 1) - 1
                if k < 0:
                    open_[capacity - s][((s, 1),)] += 1
                else:
                    t = sizes[k]
                    open_[capacity - s - t][((s, 1), (t, 1))] += 1
                    large[t] -= 1
                    if not large[t]:
                        sizes.pop(k)
            else:
                sizes.pop()
        else:
            m = min(n, large[t])
            open_[capacity - s - t][((s, 1), (t, 1))] += m
            large[s] -= m
            large[t] -= m
            if not large[t]:
                sizes.pop(k)
            if not large[s]:
                sizes.pop()
    gaps = sorted(g for g in open_ if open_[g])

    def add(gap: int, contents: tuple, n: int) -> None:
        if gap not in open_ or not open_[gap]:
            insort(gaps, gap)
        open_[gap][contents] += n

    for s in sorted((s for s in histogram if s * 3 <= capacity), reverse=True):
        left = histogram[s]
        while left:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                per = capacity // s
                full, rest = divmod(left, per)
                if full:
                    add(capacity - per * s, ((s, per),), full)
                if rest:
                    add(capacity - rest * s, ((s, rest),), 1)
                break
            gap = gaps[i]
            contents, n = next(iter(open_[gap].items()))
            per = gap // s
            if left >= per:
                m = min(n, left // per)
                put = per
            else:
                m, put = 1, left
            open_[gap][contents] -= m
            if not open_[gap][contents]:
                del open_[gap][contents]
            if not open_[gap]:
                gaps.pop(i)
            add(gap - put * s, (*contents, (s, put)), m)
            left -= m * put
    return [(c, n) for g in sorted(open_) for c, n in sorted(open_[g].items()) if n]


def pieces(items: DataFrame, id_column: str, size: str, capacity: int) -> DataFrame:
    """(id, part_no, start_at, size): an item of more than ``capacity`` in whole containers and a rest, else itself."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(capacity)).cast("int"))
    x = items.select(id_column, F.coalesce(F.col(size), F.lit(0)).alias(size)).withColumn("part_no", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("part_no") * F.lit(capacity)
    return x.select(id_column, "part_no", start.alias("start_at"), F.least(F.lit(capacity), F.col(size) - start).alias("size"))


def pack(items: DataFrame, id_column: str, size: str, capacity: int) -> DataFrame:
    """id, part_no, start_at, size, container_id of each item (part).

    An item is split only if it exceeds the capacity. Items of size 0 (null, empty) need no room and lie in container
    0. Items of one id and part are kept apart by nothing else than their rank, so ids should be distinct; repeated
    ids are packed as often as they occur. An empty table gives no rows.
    """
    x = materialize(pieces(items, id_column, size, capacity))
    histogram = {r["size"]: r["n"] for r in x.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # size: (first rank, first container, items in each)
    used: dict[int, int] = defaultdict(int)
    container = 0
    for contents, n in plan_containers(histogram, capacity):
        for s, k in contents:
            runs[s].append((used[s], container, k))
            used[s] += n * k
        container += n
    tables = {s: tuple(np.array(v, "int64").T) for s, v in runs.items()}

    @F.pandas_udf("bigint")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, ranks in batches:
            s, r = sizes.to_numpy("int64"), ranks.to_numpy("int64") - 1
            out = np.zeros(len(s), "int64")
            for v in np.unique(s):
                at = s == v
                if v > 0:
                    first, start, k = tables[int(v)]
                    i = np.searchsorted(first, r[at], side="right") - 1
                    out[at] = start[i] + (r[at] - first[i]) // k[i]
            yield pd.Series(out)

    ranked = rank_within(x, ["size"], [id_column, "part_no"], "rank")
    return ranked.select(id_column, "part_no", "start_at", "size", place("size", "rank").alias("container_id"))

