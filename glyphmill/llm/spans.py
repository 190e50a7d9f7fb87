"""Problem 9: long exact spans shared between records.

Difference-cover anchors.  ``D`` is a difference cover modulo ``v``: for any two
positions i and j there is an offset d < v with both i + d and j + d in D.  Any
match of at least ``length`` characters therefore holds, at the same offset on
both sides, a window of ``length - v + 1`` characters that starts at a cover
position.  Only those windows are hashed (12 of 133 positions for length 240);
windows whose hash stands in two different texts are the anchors.  An anchor
extends to the positions of all full-length windows around it, and these are
compared by a 128-bit hash, so no pair of occurrences is ever formed.

Plan.  Texts are told apart by a hash of the whole text.  One scan writes a table of
identifiers, hashes and lengths; copies of a text, known from that table, are taken
out before anything is hashed and share the whole text at the end.  A batch resolves
the hashes it can by itself: where two texts of the batch share a hash, their entries
are passed on at random with a single witness for others, hence a hash has at most one
unresolved text per batch in the shuffle, however often a passage is repeated.
Entries travel as packed arrays to buckets of about ``BUCKET_ENTRIES`` entries, whose
number comes from the length of all texts, so a task's memory does not grow with the
input.  Positions of a text are gathered once each, as many as it has at most.  The
few anchors are staged as a table; joins with it are broadcasts only where Spark
finds it below the session's threshold, and shuffle joins otherwise.

Defined cases: null texts and texts shorter than ``length`` have no spans; a
repeat inside one document only is no shared span; documents with equal texts
of at least ``length`` characters share them whole; an empty table gives no rows;
rows repeated with the same identifier are one document; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.plans import stage

#: Characters hashed together, and entries gathered before they are packed.
BATCH_CHARS = 2_000_000
BATCH_ENTRIES = 1_000_000
#: Entries of a bucket, which one task compares.
BUCKET_ENTRIES = 500_000


@lru_cache(maxsize=16)
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """Perfect difference set of q + 1 residues modulo q*q + q + 1, for a prime q.

    The powers of x in GF(q^3) that lie in a plane through the origin; a cubic is
    accepted when its set is seen to cover all differences.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = ((c * x[2]) % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
                    return v, tuple(found)
    raise ValueError(f"{q} is not prime")


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose period is at most 0.6 of the span length."""
    best = (1, (0,))
    for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31):
        if q * q + q + 1 <= 0.6 * length:
            best = difference_cover(q)
    return best


class Hasher:
    """Window hashes of texts by prefix sums of an odd-base polynomial modulo 2^64."""

    def __init__(self, seed: int):
        self.base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64 | 1
        self.inverse = pow(self.base, -1, 2**64)
        self._up = self._down = None

    def _powers(self, n: int):
        import numpy as np

        if self._up is None or len(self._up) < n:
            size = max(n, 4096) * 2
            self._up = np.cumprod(np.full(size, self.base, np.uint64))
            self._down = np.cumprod(np.full(size, self.inverse, np.uint64))
        return self._up, self._down

    def windows(self, codes, starts, width: int):
        import numpy as np

        up, down = self._powers(len(codes))
        with np.errstate(over="ignore"):
            c = codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
            c ^= c >> np.uint64(29)
            c *= np.uint64(0xBF58476D1CE4E5B9)
            c ^= c >> np.uint64(32)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(c * up[: len(codes)], out=sums[1:])
            h = (sums[starts + width] - sums[starts]) * down[starts]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x94D049BB133111EB)
            return h ^ (h >> np.uint64(29))


def _pack(h, g, text, pos, n_buckets: int, salt: int):
    """Rows (bucket, blob) of one batch; resolves what the batch can resolve alone.

    state 0: not known to be repeated; 1: known to be repeated; 2: witness.
    """
    import numpy as np

    order = np.lexsort((text, g, h)) if g is not None else np.lexsort((text, h))
    h, text, pos = h[order], text[order], pos[order]
    g = g[order] if g is not None else None
    new = np.r_[True, h[1:] != h[:-1]]
    if g is not None:
        new[1:] |= g[1:] != g[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(h)])
    last = first + size - 1
    shared = text[first] != text[last]
    known = np.repeat(shared, size)
    bucket = (h % np.uint64(n_buckets)).astype(np.int32)
    # entries already known go anywhere; one witness stays with the hash
    known_bucket = ((pos.astype(np.uint64) + text.astype(np.uint64) + np.uint64(salt)) % np.uint64(n_buckets)).astype(np.int32)
    witness = first[shared]
    bucket = np.r_[np.where(known, known_bucket, bucket), bucket[witness]]
    state = np.r_[known.astype(np.uint8), np.full(len(witness), 2, np.uint8)]
    index = np.r_[np.arange(len(h)), witness]
    by_bucket = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
    for pick in np.split(by_bucket, cuts):
        at = index[pick]
        at_order = np.lexsort((h[at], text[at]))
        b, pick, at = bucket[pick[0]], pick[at_order], at[at_order]
        texts, local = np.unique(text[at], return_inverse=True)
        step, place, marks = np.diff(local.astype(np.int64), prepend=0), pos[at], state[pick]
        small, short, plain = int(step.max()) < 256, int(place.max()) < 65536, not marks.any()
        head = np.array([len(texts), len(at), g is not None, small, short, plain], np.int32).tobytes()
        parts = [head, texts.tobytes(), h[at].tobytes(), g[at].tobytes() if g is not None else b""]
        parts += [step.astype(np.uint8 if small else np.int32).tobytes(), place.astype(np.uint16 if short else np.int32).tobytes(), b"" if plain else marks.tobytes()]
        yield int(b), b"".join(parts)


def _unpack(blob: bytes):
    import numpy as np

    n_texts, n, wide, small, short, plain = np.frombuffer(blob, np.int32, 6).tolist()
    at = 24

    def take(kind, count: int):
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    texts, h = take(np.int64, n_texts), take(np.uint64, n)
    g = take(np.uint64, n) if wide else np.zeros(n, np.uint64)
    local = np.cumsum(take(np.uint8 if small else np.int32, n).astype(np.int64))
    pos = take(np.uint16 if short else np.int32, n).astype(np.int32)
    return h, g, texts[local], pos, np.zeros(n, np.uint8) if plain else take(np.uint8, n)


def _reduce(blobs: list[bytes]):
    """(text, positions) of the entries of one bucket that are repeated in another text."""
    import numpy as np
    import pyarrow as pa

    parts = list(map(_unpack, blobs))
    h, g, text, pos, state = (np.concatenate(x) for x in zip(*parts))
    direct = state == 1
    order = np.lexsort((text, g, h))
    h, g, text, pos, state = h[order], g[order], text[order], pos[order], state[order]
    direct = direct[order]
    grouped = ~direct
    hh, gg, tt, ss = h[grouped], g[grouped], text[grouped], state[grouped]
    hit = direct.copy()
    if len(hh):
        first = np.flatnonzero(np.r_[True, (hh[1:] != hh[:-1]) | (gg[1:] != gg[:-1])])
        size = np.diff(np.r_[first, len(hh)])
        shared = (tt[first] != tt[first + size - 1]) | np.maximum.reduceat(ss == 2, first)
        hit[np.flatnonzero(grouped)] = np.repeat(shared, size) & (ss == 0)
    text, pos = text[hit], pos[hit]
    order = np.lexsort((pos, text))
    text, pos = text[order], pos[order]
    once = np.r_[True, (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])] if len(text) else np.zeros(0, bool)
    text, pos = text[once], pos[once]
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(text)].astype(np.int32)), pa.array(pos.astype(np.int32)))
    return pa.table({"tid": pa.array(text[first]), "positions": lists})


def _repeated(texts: DataFrame, length: int, anchors: bool, n_buckets: int) -> DataFrame:
    """``(tid, positions)``: window starts whose window also stands in another text.

    ``texts`` has tid and text; for the second step also ``near``, the anchors' starts.
    """
    v, cover = cover_for(length)
    width = length - v + 1 if anchors else length

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        one, two = Hasher(1), Hasher(2)
        residue = np.zeros(v, bool)
        residue[list(cover)] = True
        held: list[tuple] = []
        seen: set[int] = set()
        count = number = 0

        def flush():
            nonlocal held, count, number
            if held:
                h, g, tid, pos = (np.concatenate(x) if x[0] is not None else None for x in zip(*held))
                number += 1
                rows = list(_pack(h, g, tid, pos, n_buckets, number))
                held, count = [], 0
                seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

        def hash_block(block):
            codes = np.frombuffer("".join(t for _, t, _ in block).encode("utf-32-le"), np.uint32)
            ends = np.cumsum([len(t) for _, t, _ in block])
            starts, tids, own = [], [], []
            for (tid, t, near), end in zip(block, ends):
                n = len(t)
                if anchors:
                    at = np.flatnonzero(np.resize(residue, n - width + 1))
                else:
                    mark = np.zeros(n + 2, np.int32)
                    near = np.asarray(near, np.int64)
                    # windows of full length that hold the anchor
                    lo = np.maximum(0, near - (v - 1))
                    hi = np.minimum(near, n - length)
                    ok = hi >= lo
                    np.add.at(mark, lo[ok], 1)
                    np.add.at(mark, hi[ok] + 1, -1)
                    at = np.flatnonzero(np.cumsum(mark)[: n - length + 1])
                own.append(at)
                starts.append(at + (end - n))
                tids.append(np.full(len(at), tid, np.int64))
            at = np.concatenate(starts)
            return one.windows(codes, at, width), None if anchors else two.windows(codes, at, width), np.concatenate(tids), np.concatenate(own).astype(np.int32)

        block, chars = [], 0
        for batch in batches:
            nears = batch.column(2).to_pylist() if not anchors else [None] * batch.num_rows
            for tid, t, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), nears):
                if tid in seen:
                    continue
                seen.add(tid)
                block.append((tid, t, near))
                chars += len(t)
                if chars >= BATCH_CHARS:
                    held.append(hash_block(block))
                    count += len(held[-1][0])
                    block, chars = [], 0
                    if count >= BATCH_ENTRIES:
                        yield from flush()
        if block:
            held.append(hash_block(block))
        yield from flush()

    packed = texts.mapInArrow(hashed, "bucket int, blob binary")

    def reduced(batches: Iterator) -> Iterator:
        blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
        if blobs:
            yield from _reduce(blobs).to_batches()

    # one task for each bucket, whatever the session's setting
    return packed.repartitionById(n_buckets, F.col("bucket")).mapInArrow(reduced, "tid bigint, positions array<int>")


def _buckets(entries: float) -> int:
    return max(1, math.ceil(entries / BUCKET_ENTRIES))


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 240) -> DataFrame:
    """``(id_col, start_pos, end_pos)`` of all merged stretches of ``length`` characters found in another document."""
    v, cover = cover_for(length)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= length)
    tids = [F.xxhash64("text").alias("tid"), F.xxhash64(F.lit(7), "text").alias("tid2")]
    keys = stage(docs.select("id", *tids, F.length("text").alias("n")), "texts")
    copied = stage(keys.groupBy("tid", "tid2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("tid", "tid2", "lo"), "copied")
    later = stage(keys.join(copied, ["tid", "tid2"]).where("id <> lo").select("id").distinct(), "later")
    entries = keys.agg(F.sum(F.col("n") - length + v)).first()[0] or 0
    one = docs.join(later, "id", "left_anti").select("text", *tids)
    near = _repeated(one.select("tid", "text"), length, True, _buckets(entries * len(cover) / v))
    near = stage(near.groupBy("tid").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("near")), "anchors")
    reach = F.least(F.size("near") * v, F.array_max("near") - F.array_min("near") + v)
    entries = near.agg(F.sum(reach.cast("bigint"))).first()[0] or 0
    close = one.join(near, "tid").select(F.col("tid2").alias("tid"), "text", "near")
    starts = _repeated(close, length, False, _buckets(entries)).groupBy("tid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("p"))
    # positions to spans: a new span begins where the gap to the last window is more than its length
    begin = F.filter("p", lambda x, i: (i == 0) | (x - F.get("p", i - 1) > length))
    end = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) - x > length))
    spans = starts.select("tid", F.explode(F.arrays_zip(begin.alias("b"), end.alias("e"))).alias("s"))
    spans = stage(spans.select(F.col("tid").alias("tid2"), F.col("s.b").alias("start_pos"), (F.col("s.e") + length).alias("end_pos")), "spans")
    whole = keys.join(copied, ["tid", "tid2"], "left_semi").select("id", F.lit(0).alias("start_pos"), F.col("n").alias("end_pos"))
    part = keys.join(copied, ["tid", "tid2"], "left_anti").join(spans, "tid2").select("id", "start_pos", "end_pos").distinct()
    return part.unionByName(whole.distinct()).withColumnRenamed("id", id_col)


def shared_amount(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 240) -> DataFrame:
    """``(id_col, n_spans, shared_chars, n_chars)`` of every document with a span shared elsewhere."""
    spans = shared_spans(df, id_col, text_col, length)
    sums = spans.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    return sums.join(df.select(id_col, F.length(text_col).alias("n_chars")), id_col)


def p9_found(df: DataFrame) -> DataFrame:
    return shared_spans(df)
