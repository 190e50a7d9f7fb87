"""Problem 2: missing or wrong language labels, and values of several languages.

A byte convolutional network gives every sentence a distribution over languages:
byte embeddings, filters of several widths, maximum over positions, softmax.  It
is trained in numpy on the driver from labelled text and applied to batches of
windows of fixed length; longer sentences average their windows.  Trusted labels
are those that the source's name confirms.  A value's sentences are then joined
to segments by the best path through the languages: changing the language costs
``SWITCH``, and the label as delivered, right far more often than not, counts as
weak evidence.

Plan.  Training reads at most about ``PER_LANGUAGE`` labelled rows of each
language, chosen by a hash of the identifier in one narrow pass (a documented
parameter; only the fit is bounded).  Applying the model is one narrow pass over
all rows; sentences that differ only in their numbers are classified once per
worker, up to ``MEMO`` of them.

Defined cases: null values and values with fewer than ``min_letters`` letters
have no language; where no row has a trusted label nothing is assigned; labels
are compared without case and without what follows ``-`` or ``_``; a label that is
no language code is missing; repeated rows have equal results; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.mojibake import _folded, unmixed
from glyphmill.llm.sentences import DIGITS, SETS, sentence_spans

PER_LANGUAGE = 1000
WINDOW, STRIDE = 96, 72
WIDTHS, FILTERS, EMBED = (2, 3, 4), 40, 8
EPOCHS, CLEANING, BATCH, RATE, SEED = 4, 2, 64, 0.004, 7
SWITCH, FLOOR, LABEL_BONUS, SHORT = 3.0, -12.0, 0.7, 18
#: Probability of its label under which a text of one sentence is taken out of the training.
DOUBTFUL = 0.02
#: Windows of a group within which batches are formed by length.
GROUP = 32 * BATCH
MEMO = 150_000
#: Fewest trusted rows that make a language known.
LEAST = 20

_DIGITS = re.compile("[0-9]+")
_DROP = re.compile(r"\\[nrt\"]|\[\w+\]|\{\w*\}|\s+")


def normal(text: str) -> bytes:
    """Bytes that are classified: letters in lower case, numbers as one digit, single spaces."""
    t = _DIGITS.sub("0", _DROP.sub(" ", text))
    if not t.isascii():
        t = " ".join([w if w.isascii() else _word(w) for w in t.split(" ")])
    return t.lower().strip().encode("utf-8")


@lru_cache(maxsize=100_000)
def _word(word: str) -> str:
    """A word with uniform width and look-alikes put into its own script."""
    return unmixed("".join(map(_folded, word)))


def windows(raw: bytes) -> list[bytes]:
    if len(raw) <= WINDOW:
        return [raw]
    return [raw[i : i + WINDOW] for i in range(0, len(raw) - WINDOW + STRIDE, STRIDE)]


def to_matrix(parts: list[bytes]):
    import numpy as np

    return np.frombuffer(b"".join(p[:WINDOW].ljust(WINDOW, b"\0") for p in parts), np.uint8).reshape(len(parts), WINDOW)


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Let this process multiply on one thread: the products are small, and further threads only wait, which costs as much again."""
    import ctypes
    from pathlib import Path

    import numpy as np

    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def cropped(x):
    """Windows without the zeros that all of them end in, but for those that a filter sees past their ends."""
    import numpy as np

    used = np.flatnonzero(x.any(axis=0))
    return np.ascontiguousarray(x[:, : min(x.shape[1], (int(used[-1]) if len(used) else 0) + max(WIDTHS) + 2)])


class ByteCnn:
    """Byte convolutional network with multi-width filters, max pooling and softmax."""

    def __init__(self, langs: list[str], seed: int = SEED):
        import numpy as np

        one_thread()
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        self.p["e"][0] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)

    def _pooled(self, x, back: bool = False):
        import numpy as np

        e = self.p["e"][x]
        n, length, d = e.shape
        hidden, kept = [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.as_strided(e, (n, length - w + 1, w * d), (e.strides[0], e.strides[1], e.strides[2]))
            conv = (view.reshape(-1, w * d) @ self.p[f"w{w}"]).reshape(n, length - w + 1, FILTERS)
            if back:
                at = conv.argmax(1)
                top = np.take_along_axis(conv, at[:, None], 1)[:, 0]
                kept.append((view, at))
            else:
                top = conv.max(1)
            hidden.append(np.maximum(top + self.p[f"b{w}"], 0))
        return np.concatenate(hidden, 1), kept

    def log_probabilities(self, x, batch: int = 256):
        import numpy as np

        out = []
        for i in range(0, len(x), batch):
            h, _ = self._pooled(cropped(x[i : i + batch]))
            z = h @ self.p["o"] + self.p["c"]
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)

    def gradients(self, x, y):
        import numpy as np

        h, kept = self._pooled(x, True)
        z = h @ self.p["o"] + self.p["c"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        loss = -np.log(q[np.arange(len(y)), y] + 1e-9).mean()
        dz = q
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        g = {"o": h.T @ dz, "c": dz.sum(0), "e": np.zeros_like(self.p["e"])}
        dh = (dz @ self.p["o"].T) * (h > 0)
        rows = np.arange(len(y))[:, None]
        for k, (w, (view, at)) in enumerate(zip(WIDTHS, kept)):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            picked = view[rows, at]
            g[f"w{w}"] = np.einsum("nf,nfk->kf", d, picked, optimize=True)
            g[f"b{w}"] = d.sum(0)
            back = (d[:, :, None] * self.p[f"w{w}"].T[None]).reshape(-1, w, EMBED)
            bytes_at = x[rows[:, :, None], at[:, :, None] + np.arange(w)].reshape(-1)
            flat = back.reshape(-1, EMBED)
            for j in range(EMBED):
                g["e"][:, j] += np.bincount(bytes_at, flat[:, j], 256).astype(np.float32)
        g["e"][0] = 0
        return loss, g

    def fit(self, x, y, epochs: int = EPOCHS, seed: int = SEED):
        """Adam with a falling rate."""
        import numpy as np

        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        total, t = max(1, epochs * -(-len(x) // BATCH)), 0
        size = (x != 0).sum(axis=1)
        for _ in range(epochs):
            # random groups, of which windows of like length go together
            order = rng.permutation(len(x))
            order = np.concatenate([g[np.argsort(size[g], kind="stable")] for g in np.split(order, range(GROUP, len(order), GROUP))])
            starts = np.arange(0, len(x), BATCH)
            for i in rng.permutation(starts):
                pick = order[i : i + BATCH]
                _, g = self.gradients(cropped(x[pick]), y[pick])
                rate = RATE * (1 - t / total) + 1e-5
                t += 1
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.01 * (g[k] ** 2 - s[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)
        return self


def label_code(label: Column) -> Column:
    """Language code of a delivered label: lower case, without region."""
    return F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))


def source_code(source: Column, codes: list[str]) -> Column:
    """First language code among the tokens of a source's name."""
    tokens = F.split(F.regexp_replace(F.lower(source), r"\.[a-z]+$", ""), r"[_.\-]")
    return F.get(F.filter(tokens, lambda t: t.isin(codes)), 0)


def training_rows(df: DataFrame, codes: list[str], value_col: str, label_col: str, source_col: str, id_col: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """About ``per_language`` (language, text) rows of each language whose label the source confirms."""
    rows = df.select(F.col(id_col).alias("id"), F.col(value_col).alias("v"), label_code(F.col(label_col)).alias("l"), source_code(F.col(source_col), codes).alias("s"))
    rows = rows.where(F.col("l").isin(codes) & F.coalesce(F.col("l") == F.col("s"), F.lit(True)) & F.col("v").isNotNull() & (F.length("v") >= 20))
    sums = {r.l: r for r in rows.groupBy("l").agg(F.count("s").alias("sure"), F.count(F.lit(1)).alias("n")).collect() if r.sure}
    # languages short of confirmed rows also learn from delivered labels in sources without a code
    short = [c for c, r in sums.items() if r.sure < LEAST]
    rows = rows.where(F.col("s").isNotNull() | F.col("l").isin(short))
    counts = {c: r.n if c in short else r.sure for c, r in sums.items()}
    if not counts:
        return []
    keep = F.coalesce(*[F.when(F.col("l") == c, F.lit(int(2**31 * min(1.0, per_language / n)))) for c, n in sorted(counts.items())], F.lit(0))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(2**31)) < keep).select("l", "v", F.xxhash64("id").alias("h"))
    found = sorted(picked.collect(), key=lambda r: (r.l, r.h, r.v))
    return [(r.l, r.v) for r in found]


def train(rows: list[tuple[str, str]]) -> ByteCnn | None:
    """Fit a network on (language, text) rows, drop the sentences that it contradicts, and go on."""
    import numpy as np

    langs = sorted({c for c, _ in rows})
    if not langs:
        return None
    parts, labels, alone = [], [], []
    for c, text in rows:
        # the units that are classified later: all sentences of a text, all their windows
        spans = sentence_spans(text, c if c in SETS else None)
        for lo, hi in spans:
            if letters(text[lo:hi]) >= 4:
                for w in windows(normal(text[lo:hi])):
                    parts.append(w)
                    labels.append(langs.index(c))
                    alone.append(len(spans) == 1)
    x, y = to_matrix(parts), np.array(labels)
    net = ByteCnn(langs).fit(x, y, epochs=CLEANING)
    # the network itself finds wrong labels, and more readily in texts of several sentences, which may be of several languages
    logs = net.log_probabilities(x)
    agreed = (logs.argmax(axis=1) == y) | (np.array(alone) & (logs[np.arange(len(y)), y] > math.log(DOUBTFUL)))
    return net.fit(x[agreed], y[agreed])


def letters(text: str) -> int:
    """Number of letters (Unicode L)."""
    return sum(map(str.isalpha, text))


def best_path(logs, weights: list[float], bonus) -> list[int]:
    """Languages of consecutive sentences by dynamic programming."""
    import numpy as np

    emit = np.maximum(logs, FLOOR) * np.array(weights)[:, None] + bonus * np.array(weights)[:, None]
    score, back = emit[0], []
    for e in emit[1:]:
        change = score.max() - SWITCH
        stay = score >= change
        back.append(np.where(stay, np.arange(len(score)), int(score.argmax())))
        score = np.where(stay, score, change) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Labeller:
    """Applies a network to values; remembers the sentences it has seen."""

    def __init__(self, model: ByteCnn):
        one_thread()
        self.model = model
        self.memo: dict[bytes, object] = {}
        self.known: dict[tuple[str, str | None], list[tuple[int, str, float]]] = {}
        self.index = {c: i for i, c in enumerate(model.langs)}

    def classify(self, raws: list[bytes]) -> None:
        import numpy as np

        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [r for r in dict.fromkeys(raws) if r not in self.memo]
        parts = [windows(r) for r in new]
        flat = [w for p in parts for w in p]
        order = np.argsort([len(w) for w in flat], kind="stable")  # windows of like length go together
        logs = np.empty((len(flat), len(self.model.langs)), np.float32)
        logs[order] = self.model.log_probabilities(to_matrix([flat[i] for i in order]))
        at = 0
        for r, p in zip(new, parts):
            if len(p) == 1:
                self.memo[r] = logs[at]
            else:
                share = np.array([len(w) for w in p], np.float32)
                self.memo[r] = (logs[at : at + len(p)] * (share / max(1, share.sum()))[:, None]).sum(0)
            at += len(p)

    def segments(self, values: list[str], hints: list[str | None]) -> list[list[tuple[int, str, float]]]:
        """(start, language, confidence) of the segments of each value."""
        import numpy as np

        cut = [[(s, v[s:e]) for s, e in sentence_spans(v, hint if hint in SETS else None)] for v, hint in zip(values, hints)]
        cut = [[(s, normal(t), letters(t)) for s, t in c] for c in cut]
        self.classify([raw for c in cut for _, raw, _ in c])
        out = []
        for c, hint in zip(cut, hints):
            if not c:
                out.append([])
                continue
            if len(c) == 1:
                start, raw, _ = c[0]
                one = self.memo[raw] if raw in self.memo else self._again(raw)
                if hint in self.index:
                    one = one.copy()
                    one[self.index[hint]] += LABEL_BONUS
                k = int(one.argmax())
                out.append([(start, self.model.langs[k], math.exp(min(0.0, float(self.memo[raw][k]))))])
                continue
            logs = np.stack([self.memo[raw] if raw in self.memo else self._again(raw) for _, raw, _ in c])
            weights = [min(1.0, n / SHORT) for _, _, n in c]
            bonus = np.zeros(len(self.model.langs), np.float32)
            if hint in self.index:
                bonus[self.index[hint]] = LABEL_BONUS
            path = best_path(logs, weights, bonus)
            spans, probability = [], np.exp(logs)
            for k, lang in enumerate(path):
                if k and lang == path[k - 1]:
                    spans[-1][2].append(float(probability[k, lang]))
                else:
                    spans.append((c[k][0], self.model.langs[lang], [float(probability[k, lang])]))
            out.append([(s, lang, sum(p) / len(p)) for s, lang, p in spans])
        return out

    def labelled(self, values: list[str], hints: list[str | None]) -> list[list[tuple[int, str, float]]]:
        """Segments; values that differ in their digits, not in how many there are, are judged once."""
        keys = [(DIGITS.sub("0", v), h) for v, h in zip(values, hints)]
        if len(self.known) > MEMO:
            self.known.clear()
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        self.known.update(zip(new, self.segments([v for v, _ in new], [h for _, h in new])))
        return [self.known[k] for k in keys]

    def _again(self, raw: bytes):
        self.classify([raw])
        return self.memo[raw]


_made: dict[int, Labeller] = {}


def _labeller(key: int, model: ByteCnn) -> Labeller:
    """The worker's labeller for a network; kept from task to task, with what it has seen."""
    if key not in _made:
        _made.clear()
        _made[key] = Labeller(model)
    return _made[key]


def languages_of(
    df: DataFrame, codes: list[str], id_col: str = "entry_id", value_col: str = "value", label_col: str = "lang", source_col: str = "file", min_letters: int = 20
) -> DataFrame:
    """``(id_col, label, segment_no, start_pos, lang, confidence, n_segments)`` of every value with enough letters."""
    spark = df.sparkSession
    model = train(training_rows(df, codes, value_col, label_col, source_col, id_col))
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, label string, segment_no int, start_pos int, lang string, confidence double, n_segments int"
    code = label_code(F.col(label_col))
    label = F.when(code.isin(codes), code)
    rows = df.select(F.col(id_col), F.col(value_col), label.alias("label")).where(F.length(value_col) >= min_letters)
    if model is None:
        return spark.createDataFrame([], schema)
    shared, number = spark.sparkContext.broadcast(model), uuid.uuid4().int

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        labeller = _labeller(number, shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                values, labels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                pick = [i for i, v in enumerate(values) if letters(v) >= min_letters]
                found = labeller.labelled([values[i] for i in pick], [labels[i] for i in pick])
                flat = [(i, labels[i], k, at, lang, p, len(segs)) for i, segs in zip(pick, found) for k, (at, lang, p) in enumerate(segs, 1)]
                cols = list(zip(*flat)) or [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, kind) for c, kind in zip(cols[1:], (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())))],
                    [id_col, "label", "segment_no", "start_pos", "lang", "confidence", "n_segments"],
                )

    return rows.mapInArrow(run, schema)


def wrong_labels(segments: DataFrame) -> DataFrame:
    """Segments of the values whose label is missing or is not the language of the whole value."""
    return segments.where(F.col("label").isNull() | (F.col("n_segments") > 1) | (F.col("label") != F.col("lang")))


def p2_found(df: DataFrame, languages: DataFrame) -> DataFrame:
    codes = [r.code for r in languages.select("code").where("code is not null").distinct().orderBy("code").limit(1000).collect()]
    return wrong_labels(languages_of(df, codes)).select("entry_id", "segment_no", "lang")
