"""Periodic runs of words, found by seed and extend on diagonals.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q`` apart are
identical), at least ``max(LEAST, 2 * q)`` words long, and which no neighbouring word extends. Words
``q`` apart agree along one diagonal (lag ``q``) over the run's length less ``q``: that overlap is at
least ``max(LEAST - q, q)`` words, which fixes how long a shared k-gram every run is sure to hold.

Lags are taken in tiers. Up to 11 the guaranteed overlap is 6 words, so 6-grams are indexed at every
position. From ``k`` to ``2 * k - 1`` it is ``k``, so one of the ``k / 2``-grams that start at
multiples of ``k / 2`` lies wholly in it: only those look for an equal gram one of these lags further
on. That is at most ``2 * n`` pairs a tier however often a word repeats, and no pair is left out.
Along a lag the furthest position already covered suppresses every later seed of the same stretch;
seeds inside a run whose period divides the lag are dropped before that, as they can only find that
run again. Extension compares words exactly, so a chance equality of hashes costs time only.

Runs lie within one text, so no row leaves its partition. Words are ``[^\\x20\\x09-\\x0D]+``. Null,
empty and wordless texts have no words and no runs, and an empty collapsed text. Repeated rows give
repeated results, null ids stay null, an empty table gives no rows, extra columns are ignored.
Memory is proportional to one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import bound_batches, slices

#: fewest words of a run
LEAST = 12
#: k-gram of the first tier: the least overlap of a run with itself at any lag, ``min(max(12 - q, q))``
SEED_WORDS = 6
_MULTIPLIER = 0x9E3779B97F4A7C15


def split_words(doc_id, text: bytes | None) -> list[bytes]:
    """Words of a text, as bytes: bytes split at ASCII white space only."""
    return (text or b"").split()


def _gram_hashes(sums: np.ndarray, inverse: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for every run of ``width`` words; equal runs have equal hashes."""
    return (sums[width:] - sums[:-width]) * inverse[: len(sums) - width]


def _seeds(grams: np.ndarray, low: int, high: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag): positions at multiples of ``step`` whose gram comes again ``low .. high`` words on."""
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(fresh) - 1
    span = n + high + 2
    keys = group[order] * span + order
    at = np.arange(0, n, step)
    first = np.searchsorted(keys, group[at] * span + at + low)
    last = np.searchsorted(keys, group[at] * span + at + high, side="right")
    many = last - first
    total = int(many.sum())
    from_ = np.repeat(at, many)
    nth = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    return from_, order[np.repeat(first, many) + nth] - from_


def _forward(words: np.ndarray, i: int, lag: int) -> int:
    """How many words from ``i`` on equal those ``lag`` further on."""
    most, done, step = len(words) - i - lag, 0, 64
    while done < most:
        step = min(step, most - done)
        a = words[i + done : i + done + step]
        differ = a != words[i + lag + done : i + lag + done + step]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += step
        step *= 2
    return most


def _backward(words: np.ndarray, i: int, lag: int) -> int:
    """How many words before ``i`` equal those ``lag`` further on."""
    done, step = 0, 64
    while done < i:
        step = min(step, i - done)
        a, b = i - done - step, i - done
        differ = (words[a:b] != words[a + lag : b + lag])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += step
        step *= 2
    return i


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    powers = np.full(n, _MULTIPLIER, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    inverse = np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    values = (ids + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers)))

    grams = _gram_hashes(sums, inverse, SEED_WORDS)
    if len(np.unique(grams)) == len(grams):
        return []
    found: dict[tuple[int, int], int] = {}
    period_at, covered_to = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low, high, step = 1, 2 * SEED_WORDS - 1, 1
    while 2 * low <= n:
        at, lag = _seeds(grams, low, high, step)
        known = period_at[at]
        again = (known > 0) & (lag % np.maximum(known, 1) == 0) & (at + lag <= covered_to[at])
        at, lag = at[~again], lag[~again]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        fresh = []
        bounds = np.flatnonzero(np.concatenate(([True], lag[1:] != lag[:-1]))) if len(lag) else []
        for first, last in zip(bounds, [*bounds[1:], len(lag)]):
            q, seeds = int(lag[first]), at[first:last]
            nth = 0
            while nth < len(seeds):
                i = int(seeds[nth])
                right = _forward(ids, i, q)
                if not right:
                    nth += 1
                    continue
                start, end = i - _backward(ids, i, q), i + right
                if end - start >= max(q, LEAST - q) and (start, end + q) not in found:
                    found[start, end + q] = q
                    fresh.append((start, end + q, q))
                nth = int(np.searchsorted(seeds, end))  # this lag is covered up to here
        for start, end, q in fresh:
            part = covered_to[start:end] < end
            covered_to[start:end][part] = end
            period_at[start:end][part] = q
        low, high = high + 1, 2 * (high + 1) - 1
        step = low // 2
        if 2 * low <= n:
            grams = _gram_hashes(sums, inverse, step)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


RUNS = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False
)


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of=split_words) -> DataFrame:
    """(id, n_words, runs, collapsed) of every text.

    ``words_of(id, text as UTF-8)`` gives a text's words, none of them with white space.
    """
    bound_batches(df.sparkSession)
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("n_words", T.LongType(), False),
            T.StructField("runs", RUNS, False),
            T.StructField("collapsed", T.StringType(), False),
        ]
    )
    row = pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])

    def run(batches):
        for part in slices(batches):
            ids, texts = part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()
            counts, ends, flat, out = [], [0], [], []
            for doc_id, text in zip(ids, texts):
                words = words_of(doc_id, text)
                found = runs(words)
                counts.append(len(words))
                flat.extend(found)
                ends.append(len(flat))
                out.append(collapsed(words, found))
            columns = np.array(flat, np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], fields=list(row))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                [f.name for f in schema],
            )

    return df.select(id_col, text_col).mapInArrow(run, schema)


def with_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of the runs and of the collapsed text.

    Of runs of equal length that with the smallest start, then period, counts as the longest.
    """
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return (
        found.withColumn("_longest", longest)
        .withColumns({"start": F.col("_longest.start"), "length": -F.col("_longest.less"), "period": F.col("_longest.period")})
        .withColumns(
            {
                "n_runs": F.size("runs").cast("bigint"),
                "exponent_milli": F.expr("1000 * length div period"),
                "runs_sha256": F.sha2(listed.cast("binary"), 256),
                "collapsed_sha256": F.sha2(F.col("collapsed").cast("binary"), 256),
            }
        )
        .drop("_longest", "runs", "collapsed")
    )
