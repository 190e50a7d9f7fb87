"""Shared spans where copies and hot passages are many."""

import random
from collections import defaultdict

from glyphmill.llm import spans


def brute(docs, length):
    grams = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - length + 1):
            grams[t[p : p + length]].add(i)
    out = set()
    for i, t in docs:
        at = [p for p in range(len(t or "") - length + 1) if len(grams[t[p : p + length]]) > 1]
        while at:
            lo = hi = at.pop(0)
            while at and at[0] <= hi + length:
                hi = at.pop(0)
            out.add((i, lo, hi + length))
    return out


def test_one_text_copied_thousands_of_times(spark):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    hot, stock = make(150), make(45)
    docs = [(i, hot) for i in range(3000)] + [(3000 + i, make(30) + stock + make(20)) for i in range(300)]
    docs += [(4000, make(10) + hot[20:90] + make(10)), (4001, hot + "tail"), (4002, stock * 2), (4003, make(100)), (4003, None)]
    docs += [(5000, "only here, twice: " + "x" * 60), (5000, "only here, twice: " + "x" * 60)]  # one document delivered twice
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(16)
    got = [tuple(r) for r in spans.shared_spans(df, length=40).collect()]
    assert set(got) == brute(docs, 40) and len(got) == len(set(got))


def test_buckets_follow_the_input():
    assert spans._buckets(0) == 1 and spans._buckets(spans.BUCKET_ENTRIES * 7.5) == 8


def test_positions_come_once():
    import numpy as np

    h, text, pos = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.int64), np.array([10, 20, 30], np.int32)
    rows = [r for n in range(3) for r in spans._pack(h, None, text, pos, 1, n)]
    out = spans._reduce([x for _, x in rows]).to_pylist()
    assert out == [{"tid": 1, "positions": [10]}, {"tid": 2, "positions": [20]}]
