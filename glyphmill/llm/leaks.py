"""Problem 8: evaluation items that stand, whole or in part, in a training corpus.

A document leaks an item when one passage of it gives at least half of the
item's words in the item's order and at most one word in ``EDIT_SHARE`` of the
passage is changed, left out or added.

Method.  A passage with m matched words has at most m // 7 edits, so it holds a run
of words without any edit; the shortest that such a run can be depends on the
item's length only (four to seven words for items of fifteen words and more) and
is the item's window size.  Every window of that size gets a 64-bit SimHash of its
words, weighted by their rarity among the items.  The fingerprint is cut into
``RADIUS + 1`` blocks; each block has a table of buckets, and by the pigeonhole
principle the buckets of a document's window hold every item window within
``RADIUS`` bits.  Since an unchanged run has distance zero, no leak is missed: the
radius only widens the search.  (Windows of half an item differ by about nine bits for
one changed word; a radius that surely covers them, 22, makes blocks pass most of
all pairs, so they cannot be indexed.)  A candidate pair is then judged in the
region that a passage around its windows can reach, as far as the longest passage
of the item: first by the exact weighted similarity of word pairs, which a leak
cannot fall below, then by an exact alignment.

Plan.  Where the items have at most ``LOCAL_CHARS`` characters in all (checked), their
index is built once and broadcast; the corpus is read in one narrow pass, no shuffle,
whatever their number.  Larger item tables are joined: the fingerprints of items and
documents meet in a shuffle on the whole fingerprint, and the pairs are verified
after joins with the texts of both sides.

Defined cases: null and empty texts leak nothing; items without words are never
leaked; a pair comes out once, however often an identifier is repeated; empty
tables give no rows; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.words import word_finder
from glyphmill.plans import stage

EDIT_SHARE = 8
RADIUS = 3
#: Item texts up to so many characters are broadcast as one index (some 2 million words).
LOCAL_CHARS = 12_000_000
#: Words and windows that are handled at once.
BLOCK_WORDS, BLOCK_WINDOWS = 500_000, 20_000


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "little")


def half_of(n: int) -> int:
    return max(1, -(-n // 2))


def longest_passage(n: int) -> int:
    return n + n // (EDIT_SHARE - 1)


def least_run(n: int) -> int:
    """Least length of the longest run without edits in a passage that leaks an item of n words."""
    best = n
    for m in range(half_of(n), n + 1):
        e = m // (EDIT_SHARE - 1)  # edits <= (m + edits) / EDIT_SHARE
        best = min(best, -(-m // (e + 1)))
    return max(1, best)


def least_pairs(n: int) -> int:
    """Least number of the item's neighbouring word pairs that a leaking passage keeps."""
    m = half_of(n)
    return m - m // (EDIT_SHARE - 1) - 1


class ItemIndex:
    """Vocabulary, fingerprints in buckets and weighted word pairs of the items."""

    def __init__(self, items: list[tuple], radius: int = RADIUS):
        import numpy as np

        words = word_finder()
        self.ids = [i for i, _ in items]
        texts = [words((t or "").casefold()) for _, t in items]
        df = Counter(w for ws in texts for w in set(ws))
        names = sorted(df)
        self.vocabulary = {w: k for k, w in enumerate(names)}
        self.weight = np.array([min(100, round(10 * math.log(1 + len(items) / df[w]))) for w in names] + [0], np.int8)
        bits = np.array([word_hash(w) for w in names] + [0], np.uint64)
        signs = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
        self.signs = signs * self.weight[:, None]
        self.coded = [[self.vocabulary[w] for w in ws] for ws in texts]
        self.run = [least_run(len(c)) for c in self.coded]
        self.radius = radius
        self.cuts = np.linspace(0, 64, radius + 2).round().astype(np.int64)
        self.groups = {size: self._tables(size) for size in sorted({r for r, c in zip(self.run, self.coded) if c})}
        self.pairs = [self._pairs(c) for c in self.coded]

    def _tables(self, size: int):
        """Words, distinct fingerprints with their items, and the buckets of all blocks for the items of one window size."""
        import numpy as np

        known, rows, owner = np.zeros(len(self.weight), bool), [], []
        for k, c in enumerate(self.coded):
            if c and self.run[k] == size:
                known[c] = True
                rows.extend(c[i : i + size] for i in range(len(c) - size + 1))
                owner.extend([k] * (len(c) - size + 1))
        prints, place = np.unique(self.fingerprints(np.array(rows)), return_inverse=True)
        both = np.unique(np.stack([place, np.array(owner)]), axis=1)  # an item counts once for a fingerprint
        first = np.searchsorted(both[0], np.arange(len(prints) + 1))
        tables = []
        for b in range(self.radius + 1):
            block = self.block(prints, b)
            order = np.argsort(block, kind="stable").astype(np.int32)
            tables.append((block[order], order))
        return known, prints, both[1].astype(np.int32), first, tables

    def block(self, prints, b: int):
        import numpy as np

        lo, hi = int(self.cuts[b]), int(self.cuts[b + 1])
        return (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def _pairs(self, c: list[int]):
        """Keys and weights of an item's word pairs, and the weight that a leak cannot fall below."""
        import numpy as np

        a = np.array(c, np.int64)
        weight = (self.weight[a[:-1]].astype(np.int64) + self.weight[a[1:]]) if len(c) > 1 else np.zeros(0, np.int64)
        least = np.sort(weight)[: max(0, least_pairs(len(c)))].sum() if len(c) else 0
        return self.pair_keys(a), weight, int(least)

    def pair_keys(self, codes):
        return codes[:-1] * (len(self.weight) + 1) + codes[1:]

    def fingerprints(self, rows):
        """SimHash of rows of word codes."""
        import numpy as np

        out = [np.packbits(self.signs[rows[i : i + BLOCK_WINDOWS]].sum(axis=1, dtype=np.int32) > 0, axis=1, bitorder="little").view(np.uint64).ravel() for i in range(0, len(rows), BLOCK_WINDOWS)]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def near(self, prints, size: int):
        """(index into ``prints``, index of item fingerprint) of all pairs within the radius, and the number of pairs compared."""
        import numpy as np

        _, own, _, _, tables = self.groups[size]
        found, compared = [], 0
        for b, (values, order) in enumerate(tables):
            block = self.block(prints, b)
            lo, hi = np.searchsorted(values, block), np.searchsorted(values, block, "right")
            n = hi - lo
            q = np.repeat(np.arange(len(prints)), n)
            w = order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            compared += len(q)
            close = np.bitwise_count(prints[q] ^ own[w]) <= self.radius
            found.append(q[close] * len(own) + w[close])
        found = np.unique(np.concatenate(found))
        return found // len(own), found % len(own), compared

    def hits(self, codes):
        """(position, item) of the windows of ``codes`` within the radius of a window of an item."""
        import numpy as np

        places, owners = [], []
        for size, (known, _, owner, first, _) in self.groups.items():
            if len(codes) < size:
                continue
            c = np.zeros(len(codes) + 1, np.int32)
            np.cumsum(known[codes], out=c[1:])  # code -1 is the last place, never known
            at = np.flatnonzero(c[size:] - c[:-size] == size)
            for lo in range(0, len(at), 50 * BLOCK_WINDOWS):
                part = at[lo : lo + 50 * BLOCK_WINDOWS]
                q, w, _ = self.near(self.fingerprints(np.lib.stride_tricks.sliding_window_view(codes, size)[part]), size)
                n = first[w + 1] - first[w]
                places.append(np.repeat(part[q], n))
                owners.append(owner[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[w], n)])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(places), np.concatenate(owners)

    def similar(self, k: int, region) -> bool:
        """Whether the word pairs that a region shares with an item weigh enough for a leak."""
        import numpy as np

        keys, weight, least = self.pairs[k]
        return least <= 0 or int(weight[np.isin(keys, self.pair_keys(region))].sum()) >= least

    def leaked(self, texts: list[list[int]]) -> list[tuple[int, int]]:
        """(text, item) of all leaks of coded texts."""
        import numpy as np

        sizes = np.array([len(t) + 1 for t in texts])
        first = np.cumsum(sizes) - sizes
        codes = np.array([c for t in texts for c in (*t, -1)], np.int64)
        place, item = self.hits(codes)
        text = np.searchsorted(first, place, "right") - 1
        order = np.lexsort((place, item, text))
        place, item, text = place[order], item[order], text[order]
        cut = np.flatnonzero(np.r_[True, (np.diff(item) != 0) | (np.diff(text) != 0)]) if len(place) else []
        found = []
        for lo, hi in zip(cut, [*cut[1:], len(place)]):
            k, t = int(item[lo]), int(text[lo])
            begin, end = int(first[t]), int(first[t]) + len(texts[t])
            for a, b in regions(place[lo:hi].tolist(), self.run[k], longest_passage(len(self.coded[k])), begin, end):
                region = codes[a:b]
                if self.similar(k, region) and aligned(self.coded[k], region.tolist(), half_of(len(self.coded[k]))):
                    found.append((t, k))
                    break
        return found


def regions(places: list[int], size: int, reach: int, begin: int, end: int) -> list[tuple[int, int]]:
    """Regions that passages of at most ``reach`` words around windows can cover; those that overlap are one."""
    out: list[list[int]] = []
    for p in places:
        lo, hi = max(begin, p + size - reach), min(end, p + reach)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def aligned(item: list[int], text: list[int], half: int, share: int = EDIT_SHARE) -> bool:
    """Whether a passage of ``text`` gives ``half`` words of ``item`` in order with at most 1 / share of its words edited.

    Chains of equal words (i, j).  Between two links lie max(di, dj) edits, and dj
    words of the passage.  For each number of edits and of passage words among
    them only the longest chain matters.
    """
    n = len(item)
    places = defaultdict(list)
    for i, w in enumerate(item):
        places[w].append(i)
    limit = (n + n // (share - 1)) // share + 1
    links: list[tuple[int, int, dict]] = []
    low = 0
    for j, w in enumerate(text):
        while low < len(links) and links[low][1] < j - limit - 1:
            low += 1
        for i in places.get(w, ()):
            states = {(0, 0): 1}
            for x in range(low, len(links)):
                pi, pj, before = links[x]
                di, dj = i - pi - 1, j - pj - 1
                if di < 0 or dj < 0:
                    continue
                e = max(di, dj)
                if e > limit:
                    continue
                for (pe, pa), m in before.items():
                    s = (pe + e, pa + dj)
                    if s[0] <= limit and states.get(s, 0) < m + 1:
                        states[s] = m + 1
            for (e, a), m in states.items():
                if m >= half and share * e <= m + a:
                    return True
            links.append((i, j, states))
    return False


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", local_chars: int = LOCAL_CHARS) -> DataFrame:
    """``(id_col, item_col)`` of every document and item it leaks."""
    docs = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    held = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where(F.col(item_text).isNotNull())
    chars = held.agg(F.coalesce(F.sum(F.length("text") + 20), F.lit(0))).first()[0]
    found = _with_index(docs, held) if chars <= local_chars else _by_joins(docs, held)
    return found.distinct().select(F.col("doc").alias(id_col), F.col("item").alias(item_col))


def _with_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(sorted(map(tuple, items.collect()), key=str)))
    item_type = items.schema["item"].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        ix, words, kind = index.value, word_finder(), to_arrow_type(item_type)
        code = ix.vocabulary.get
        for batch in batches:
            place, found, texts, held, count = [], [], [], [], 0
            last = batch.num_rows - 1
            for at, text in enumerate(batch.column(1).to_pylist()):
                texts.append([code(w, -1) for w in words(text.casefold())])
                held.append(at)
                count += len(texts[-1])
                if count >= BLOCK_WORDS or at == last:
                    for t, k in ix.leaked(texts):
                        place.append(held[t])
                        found.append(ix.ids[k])
                    texts, held, count = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(found, kind)], ["doc", "item"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, item {item_type.simpleString()}")


def _by_joins(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same pairs for item tables of any size: fingerprints and texts meet in shuffles.

    Words weigh alike here, as their rarity among the items is not at hand; that
    changes which pairs are verified, never which are found.
    """
    sizes = range(1, EDIT_SHARE)

    def prints(name: str):
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            words, hashes = word_finder(), {}
            for batch in batches:
                place, keys = [], []
                for at, text in enumerate(batch.column(1).to_pylist()):
                    ws = words(text.casefold())
                    if len(hashes) > 500_000:
                        hashes.clear()
                    for w in set(ws) - hashes.keys():
                        hashes[w] = word_hash(w)
                    bits = np.array([hashes[w] for w in ws], np.uint64)
                    if not len(bits):
                        continue
                    signs = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
                    sums = np.r_[np.zeros((1, 64), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)]
                    for size in (least_run(len(ws)),) if name == "item" else sizes:
                        if len(ws) >= size:
                            p = np.packbits(sums[size:] - sums[:-size] > 0, axis=1, bitorder="little").view(np.uint64).ravel()
                            p = np.unique((p << np.uint64(3)) ^ (p >> np.uint64(61)) ^ np.uint64(size))
                            keys.append(p.view(np.int64))
                            place.append(np.full(len(p), at, np.int64))
                place, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (place, keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(keys)], [name, "print"])

        return run

    doc_type, item_type = docs.schema["doc"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    ours = items.mapInArrow(prints("item"), f"item {item_type}, print bigint")
    theirs = docs.mapInArrow(prints("doc"), f"doc {doc_type}, print bigint")
    pairs = stage(theirs.join(ours, "print").select("doc", "item").distinct(), "leak-pairs")
    both = pairs.join(docs, "doc").join(items.withColumnRenamed("text", "wanted"), "item").select("doc", "item", "text", "wanted")

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = word_finder()
        for batch in batches:
            pick = []
            for at, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                want = words(wanted.casefold())
                code = {w: k for k, w in enumerate(dict.fromkeys(want))}
                got = [code.get(w, -1) for w in words(text.casefold())]
                if aligned([code[w] for w in want], got, half_of(len(want))):
                    pick.append(at)
            pick = pa.array(pick, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick)], ["doc", "item"])

    return both.mapInArrow(verify, f"doc {doc_type}, item {item_type}")


def p8_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items)
