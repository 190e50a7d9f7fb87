"""Leaks: the index against a search of every text for every item by alignment alone."""

import random

import numpy as np
import pytest

from glyphmill.llm import leaks


def every_pair(ix, texts):
    """Brute force: whole texts aligned with every item, without windows, regions or weights."""
    return {(t, k) for t, c in enumerate(texts) for k, item in enumerate(ix.coded) if item and leaks.aligned(item, c, leaks.half_of(len(item)))}


def coded(ix, words):
    return [ix.vocabulary.get(w, -1) for w in words]


def items_of(sizes, rng, shared=40):
    """Items that share many of their words, as templates do."""
    return [(k, " ".join(rng.choice([f"s{rng.randrange(shared)}", f"i{k}w{i}"]) for i in range(n))) for k, n in enumerate(sizes)]


@pytest.mark.parametrize("n", [1, 3, 6, 15, 20, 28, 47, 80, 100])
def test_clustered_edits_equal_brute_force(n):
    rng = random.Random(n)
    items = items_of([n, n, max(1, n // 2)], rng)
    ix = leaks.ItemIndex(items)
    words, texts = items[0][1].split(), []
    half = leaks.half_of(n)
    for side in {half // 2, half // 2 + 1, n // 4 + 1, half}:
        for k in range(0, n // 7 + 3):  # foreign words between two stretches of the item
            for gap in (0, k):  # inserted, or in the place of words of the item
                texts.append(coded(ix, ["a"] * 9 + words[:side] + [f"x{i}" for i in range(k)] + words[side + gap : 2 * side + gap] + ["b"] * 9))
    found = set(ix.leaked(texts))
    assert found == every_pair(ix, texts) and (n < 15 or 0 < len({t for t, _ in found}) < len(texts))


def test_random_edits_equal_brute_force():
    rng = random.Random(5)
    items = items_of([rng.randint(1, 60) for _ in range(60)], rng)
    ix = leaks.ItemIndex(items)
    texts = []
    for _ in range(300):
        words = rng.choice(items)[1].split()
        lo = rng.randrange(len(words))
        part = words[lo : lo + rng.randint(1, len(words))]
        for _ in range(rng.randrange(0, 2 + len(part) // 6)):
            at = rng.randrange(len(part))
            part[at : at + rng.randrange(3)] = ["y"] * rng.randrange(3)
            part = part or ["y"]
        texts.append(coded(ix, ["c", *part, "s1", "s2", *rng.choice(items)[1].split()[:4]]))
    want = every_pair(ix, texts)
    found = set(ix.leaked(texts))
    assert len(want) > 100
    print("recall", len(found & want) / len(want))
    assert found == want


@pytest.mark.parametrize("n_items", [5_000, 50_000])
def test_buckets_pass_far_under_one_percent(n_items):
    rng = random.Random(7)
    words = lambda n: [f"w{int(60_000 * rng.random() ** 4)}" for _ in range(n)]  # noqa: E731; the first word is 6 % of all
    items = [(k, " ".join(words(20))) for k in range(n_items)]
    ix = leaks.ItemIndex(items)
    texts = [coded(ix, words(300)) for _ in range(100)]
    texts += [coded(ix, ["q"] * 5 + items[k][1].split()[3:14]) for k in range(100)]
    (size,) = ix.groups
    rows = np.array([t[i : i + size] for t in texts for i in range(len(t) - size + 1)])
    rows = rows[(rows >= 0).all(axis=1)]
    *_, compared = ix.near(ix.fingerprints(rows), size)
    assert compared < 0.001 * len(rows) * len(ix.groups[size][1])
    assert {(100 + k, k) for k in range(100)} <= set(ix.leaked(texts))


def test_fingerprints_within_the_radius_are_all_found():
    rng = np.random.default_rng(1)
    ix = leaks.ItemIndex([(k, " ".join(f"w{rng.integers(3000)}" for _ in range(20))) for k in range(300)])
    (size,) = ix.groups
    own = ix.groups[size][1]
    asked = own[rng.integers(0, len(own), 400)]
    for _ in range(leaks.RADIUS):
        asked = asked ^ (np.uint64(1) << rng.integers(0, 64, len(asked)).astype(np.uint64))
    q, w, _ = ix.near(asked, size)
    near = np.bitwise_count(asked[:, None] ^ own[None, :]) <= leaks.RADIUS
    assert set(zip(q.tolist(), w.tolist())) == set(zip(*map(lambda x: x.tolist(), np.nonzero(near))))


def test_repeated_rows_and_names_that_clash(spark):
    text = "so " + " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, "x", 1), (1, text, "y", 2), (2, None, None, None), (3, "w1 " * 30_000, "z", 3)], "doc_id bigint, text string, item string, doc int")
    items = spark.createDataFrame([("a", text[3:], 1), ("a", text[3:], 2), ("b", None, 3), ("c", "", 4), ("d", "w1", 5)], "item_id string, text string, doc_id int")
    want = {(1, "a"), (1, "d"), (3, "d")}
    for bound in (leaks.LOCAL_CHARS, 0):
        rows = leaks.leaks(docs, items, local_chars=bound).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
