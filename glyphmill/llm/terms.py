"""Problem 5: frequency of every distinct value and term.

A term is a maximal run of letters, marks and numbers of the lower-cased value.

Plan.  One narrow pass proposes heavy terms: each task counts the terms of its
own rows in a bounded summary (space saving: when it is full, all counts are
lowered together), so every term with more than ``1 / SUMMARY`` of the rows of
some task is proposed by it.  The proposals are merged by one small aggregation
and the ``MAX_HEAVY`` largest are broadcast, a table of fixed size.  The second
pass counts heavy terms in local arrays (one row per heavy term and task leaves
the task) and sends only the remaining terms to the shuffle, one row per record
and term.  Whether a term was proposed changes its path, never its count: both
tables of counts are exact and are united.

Defined cases: null values are no records for terms but every row with a
non-null value counts for the share of records; empty and blank values have no
terms; an empty table gives no rows; repeated rows count again; extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.words import word_finder
from glyphmill.plans import stage

SUMMARY = 2_000
MAX_HEAVY = 4_000


def lowered(text: str) -> list[str]:
    return word_finder()(text.lower())


def proposer(split: Callable[[str], list[str]]):
    """Map function: terms that may be heavy in the rows of one task, with a lower bound of their records."""

    def propose(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, rows = Counter(), 0
        for batch in batches:
            part: Counter = Counter()
            for v in batch.column(0).to_pylist():
                if v:
                    part.update(set(split(v)))
            rows += batch.num_rows
            held.update(part)
            if len(held) > SUMMARY:
                # lower every count by that of the first term that no longer fits
                cut = sorted(held.values(), reverse=True)[SUMMARY]
                held = Counter({t: n - cut for t, n in held.items() if n > cut})
        top = [(t, n) for t, n in held.items() if n > rows // SUMMARY]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["term", "n"])

    return propose


def heavy_terms(values: DataFrame, limit: int = MAX_HEAVY, split: Callable[[str], list[str]] = lowered) -> list[str]:
    """At most ``limit`` heavy terms, most frequent first; the driver receives a table of fixed size."""
    found = values.mapInArrow(proposer(split), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return [r.term for r in found.orderBy(F.desc("n"), "term").limit(limit).collect()]


def term_counts(df: DataFrame, value_col: str = "value") -> DataFrame:
    """``(term, occurrences, records)`` of every distinct term, exact."""
    values = df.select(F.col(value_col).alias("v")).where("v is not null")
    heavy = df.sparkSession.sparkContext.broadcast(heavy_terms(values))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = word_finder()
        place = {t: i for i, t in enumerate(heavy.value)}
        occurrences, records = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        at = place.get
        for batch in batches:
            light: list[str] = []
            times: list[int] = []
            every: list[int] = []
            once: list[int] = []
            for v in batch.column(0).to_pylist():
                low = v.lower()
                terms = words(low)
                alone = set(terms)
                if len(alone) == len(terms):
                    for t in terms:
                        i = at(t)
                        if i is None:
                            light.append(t)
                            times.append(1)
                        else:
                            once.append(i)
                            every.append(i)
                else:
                    for t, n in Counter(terms).items():
                        i = at(t)
                        if i is None:
                            light.append(t)
                            times.append(n)
                        else:
                            once.append(i)
                            every.extend([i] * n)
            if place:
                occurrences += np.bincount(np.asarray(every, np.int64), minlength=len(place))
                records += np.bincount(np.asarray(once, np.int64), minlength=len(place))
            for s in range(0, len(light), 50_000):
                part = pa.array(light[s : s + 50_000], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(times[s : s + 50_000], pa.int64()), pa.array(np.ones(len(part), np.int64)), pa.array(np.full(len(part), False))], _COLS
                )
        used = np.flatnonzero(records)
        names = heavy.value
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in used], pa.string()), pa.array(occurrences[used]), pa.array(records[used]), pa.array(np.full(len(used), True))], _COLS
        )

    counted = stage(values.mapInArrow(count, "term string, occurrences bigint, records bigint, heavy boolean"), "terms")
    sums = [F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")]
    light = counted.where("not heavy").groupBy("term").agg(*sums)
    return light.unionByName(counted.where("heavy").groupBy("term").agg(*sums))


_COLS = ["term", "occurrences", "records", "heavy"]


def value_counts(df: DataFrame, value_col: str = "value") -> DataFrame:
    """``(value, occurrences)`` of every distinct non-null value; partial counts are combined before the shuffle."""
    return df.where(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))


def marked(counts: DataFrame, n_records: int, rare_below: int = 3, common_share: float = 0.02) -> DataFrame:
    """Add ``mark``: rare, common or null."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_share * n_records, "common")
    return counts.withColumn("mark", mark)


def p5_marked_values(df: DataFrame, value_col: str = "value") -> DataFrame:
    """``value_counts`` with the number of records, here the same, and the mark of every value."""
    counts = value_counts(df, value_col)
    return marked(counts.withColumn("records", F.col("occurrences")), df.where(F.col(value_col).isNotNull()).count())


def p5_terms(df: DataFrame) -> DataFrame:
    n = df.where("value is not null").count()
    return marked(term_counts(df), n)


def p5_found(df: DataFrame) -> DataFrame:
    return p5_terms(df).where("mark is not null").select("term", "mark")
