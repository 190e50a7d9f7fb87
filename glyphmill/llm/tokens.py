"""Problem 7: token ids of every text by a public byte-level BPE vocabulary.

Merging.  A piece is a doubly linked list of symbols.  Adjacent pairs that are
in the vocabulary wait in a priority queue ordered by (rank, position); the
queue is never searched, an entry whose symbols have changed since it was pushed
is stale and is skipped when it is popped.  Cost is O(n log n) in the piece, so
very long pieces are safe.  Ids are decoded by concatenating vocabulary byte
strings.

Plan.  One narrow pass, no shuffle: Arrow batches go to Python, each worker reads
the vocabulary file once (its path is a parameter; the file is not copied) and
remembers the ids of pieces seen before.  The memory of pieces is bounded
(``MEMO`` pieces of at most ``MEMO_LEN`` characters) and never changes a result.

Defined cases: an empty text and a null text have the empty list of ids; blank
texts are encoded as they stand; strings of special tokens are ordinary text;
lone surrogates cannot occur in Spark strings; repeated rows give repeated rows;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokenisation pattern that belongs to the 50k byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of Unicode (fixed value); Python's own class also holds U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Splits at a subset of PATTERN's boundaries with the faster standard engine: runs of letters and
#: numbers stay together and are split by PATTERN itself when they are first seen.
COARSE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W_]+| ?(?:[^{_SPACE}\w]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
MEMO = 400_000
MEMO_LEN = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by merging the lowest rank first, the leftmost first among equal ranks."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    text: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            queue.append((rank, i, 1, 1))
    heapq.heapify(queue)
    while queue:
        _, left, left_len, right_len = heapq.heappop(queue)
        a = text[left]
        if a is None or len(a) != left_len:
            continue
        right = after[left]
        if right >= n or len(text[right]) != right_len:
            continue
        joined = a + text[right]
        text[left], text[right] = joined, None
        follow = after[right]
        after[left] = follow
        if follow < n:
            before[follow] = left
            rank = ranks.get(joined + text[follow])
            if rank is not None:
                heapq.heappush(queue, (rank, left, len(joined), len(text[follow])))
        prior = before[left]
        if prior >= 0:
            rank = ranks.get(text[prior] + joined)
            if rank is not None:
                heapq.heappush(queue, (rank, prior, len(text[prior]), len(joined)))
    out, i = [], 0
    while i < n:
        out.append(ranks[text[i]])
        i = after[i]
    return out


class Encoder:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        import re

        import regex

        self.ranks = read_ranks(path)
        self.pieces = re.compile(COARSE).findall
        self._memo = _Memo(self.ranks, regex.compile(PATTERN).findall)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self._memo.__getitem__, self.pieces(text)))) if text else []

    def encode_batch(self, texts: Iterable[str | None]):
        """Offsets and flat ids of a batch, as numpy arrays."""
        import numpy as np

        ids: list[int] = []
        ends = [0]
        get = self._memo.__getitem__
        for t in texts:
            if t:
                ids.extend(chain.from_iterable(map(get, self.pieces(t))))
            ends.append(len(ids))
        self._memo.trim()
        return np.asarray(ends, np.int32), np.asarray(ids, np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        return decode(ids, self.ranks)


class _Memo(dict):
    def __init__(self, ranks: dict[bytes, int], split):
        super().__init__()
        self._ranks = ranks
        self._split = split

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(chain.from_iterable(merge(p.encode("utf-8"), self._ranks) for p in self._split(piece)))
        if len(piece) <= MEMO_LEN:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > MEMO:
            self.clear()


@lru_cache(maxsize=4)
def _strings(key: int) -> dict[int, bytes]:
    return {rank: token for token, rank in _by_key[key].items()}


_by_key: dict[int, dict[bytes, int]] = {}


def decode(ids: Iterable[int], ranks: dict[bytes, int]) -> str:
    _by_key[id(ranks)] = ranks
    strings = _strings(id(ranks))
    return b"".join(strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)`` of every row; ids is never null."""
    id_type = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ends, ids = enc.encode_batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"`{id_col}` {id_type}, ids array<int>")


def p7_ids(df: DataFrame, path: str | None = None) -> DataFrame:
    return token_ids(df, path or vocabulary_path())
