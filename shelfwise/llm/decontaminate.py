"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised (lower case, every run of other characters than letters and digits is one
space) and compared as UTF-8. An item of ``m`` bytes occurs in a document if some stretch of it is
within ``k = m * RATE`` edits of the whole item. By the q-gram lemma such a stretch shares at least
``m - q + 1 - k * q`` q-grams with the item on neighbouring diagonals, so shared q-grams are
counted in overlapping diagonal bands, bands below that number are dropped, and what is left is
verified by an alignment confined to the band.

The lemma must ask for at least one shared q-gram, so short items are searched with shorter grams:
``q`` is 7 where that leaves the whole budget (from some 44 bytes on), else 3, and 1 for items of one
or two bytes. The budget is ``floor(m * RATE)`` edits for every length, so items under nine bytes must
occur as they are.

The benchmark is the stated query set: it goes to the workers in blocks of bounded size, each
against all documents. Items without a letter or digit are empty once normalised and match nothing, as do
null and empty texts; repeated rows, in either table, are reported each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfwise.llm.common import bound_batches, keep_rows, slices

Q = 7
#: grams of items too short for ``Q`` with the whole budget
SHORT = (3, 1)
RATE = 0.12
#: bytes of normalised benchmark text in a block, and bits of the first look-up table
BLOCK_BYTES = 2 << 20
#: bytes of document text looked at together; longer texts are cut into overlapping windows
WINDOW_BYTES = 1 << 17
TABLE_BITS = 22
_OTHER = re.compile(r"[\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int32(1 << 29)


def normalise(text: str | None) -> bytes:
    return _OTHER.sub(" ", (text or "").lower()).strip().encode("utf-8")


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in an item of ``m`` bytes."""
    return int(m * rate)


def gram_width(m: int, rate: float = RATE, q: int = Q) -> int:
    """Bytes of the grams an item of ``m`` bytes is searched with: the most of which the lemma asks for one."""
    for width in (q, *SHORT):
        if m - width + 1 - budget(m, rate) * width >= 1:
            return width
    raise ValueError(f"no gram width for {m} bytes at a rate of {rate}")


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """Every q-gram as one number."""
    octets = np.frombuffer(data, np.uint8)
    n = max(len(octets) - q + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out = (out << np.uint64(8)) | octets[j : j + n]
    return out


def distance(item: bytes, region: bytes, low: int, high: int, k: int) -> tuple[int, int]:
    """Least edits of the whole item against a stretch of ``region`` on diagonals ``low`` to ``high``; its end.

    Diagonals are region position less item position. More than ``k`` edits give (k + 1, -1).
    """
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    width = high - low + 1
    steps = np.arange(width, dtype=np.int32)
    padded = np.concatenate([np.zeros(max(0, -low), np.uint8), b, np.zeros(max(0, len(a) + high - len(b)), np.uint8)])
    shift = max(0, -low)
    ends = steps + low  # row 0: any start inside the region is free
    row = np.where((ends >= 0) & (ends <= len(b)), np.int32(0), _FAR)
    for i in range(1, len(a) + 1):
        at = i - 1 + low + shift
        differs = (padded[at : at + width] != a[i - 1]).astype(np.int32)
        inside = (ends + i >= 0) & (ends + i <= len(b))
        best = row + np.where(ends + i >= 1, differs, _FAR)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.where(inside, np.minimum(best, _FAR), _FAR)
        row = np.minimum(np.minimum.accumulate(best - steps) + steps, _FAR)
        row = np.where(inside, row, _FAR)
        if row.min() > k:
            return k + 1, -1
    at = int(np.argmin(row))
    return int(row[at]), len(a) + low + at


class Index:
    """Sorted q-grams of a block of items with their places."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, q: int):
        self.q = q
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.budgets = np.array([budget(len(t), rate) for t in self.texts], np.int64)
        self.need = np.array([len(t) - q + 1 - k * q for t, k in zip(self.texts, self.budgets)], np.int64)
        every = [grams(t, q) for t in self.texts]
        codes = np.concatenate(every) if every else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(g) for g in every])
        place = np.concatenate([np.arange(len(g)) for g in every]) if every else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._cell(self.codes)] = True

    @staticmethod
    def _cell(codes: np.ndarray) -> np.ndarray:
        return ((codes * _ODD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in the item) of every shared q-gram."""
        codes = grams(data, self.q)
        at = np.flatnonzero(self.table[self._cell(codes)])
        codes = codes[at]
        row = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        same = self.codes[row] == codes
        at, row = at[same], row[same]
        n = self.count[row]
        before = np.cumsum(n) - n
        post = np.repeat(self.first[row] - before, n) + np.arange(int(n.sum()))
        return np.repeat(at, n), self.item[post], self.place[post]

    def regions(self, data: bytes, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, lowest diagonal) of bands that hold as many q-grams as the lemma asks.

        ``data`` holds documents that begin at ``starts``; a q-gram over a border has a byte 0 in it.
        """
        at, item, place = self.hits(data)
        doc = np.searchsorted(starts, at, side="right") - 1
        pair = doc * len(self.ids) + item
        # an item that shares too few q-grams with the whole document needs no bands
        n = np.bincount(pair, minlength=len(starts) * len(self.ids))
        keep = (n >= np.tile(self.need, len(starts)))[pair]
        at, item, place, doc, pair = at[keep], item[keep], place[keep], doc[keep], pair[keep]
        if not len(at):
            return
        step = self.budgets[item] + 1
        diagonal = at - starts[doc] - place + len(data)  # never negative
        band = diagonal // step
        spread = len(data) * 2 + 2
        keys = np.concatenate([pair * spread + band, pair * spread + band - 1])
        keys, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        need = self.need[keys // spread % len(self.ids)]
        # an alignment matches a place of the item once, so repeats of a q-gram are counted once
        crowded = (n >= need)[back]
        places = int(place.max()) + 1
        found = np.unique(back[crowded] * places + np.tile(place, 2)[crowded])
        n = np.bincount(found // places, minlength=len(keys))
        for key in keys[n >= need].tolist():
            p, b = divmod(key, spread)
            d, i = divmod(p, len(self.ids))
            yield d, i, b * (int(self.budgets[i]) + 1) - len(data)

    def windows(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Groups of (document, offset, stretch), each about :data:`WINDOW_BYTES`.

        Windows of one text overlap by more than any item with its edits, so an occurrence lies whole in one.
        """
        longest = max(map(len, self.texts))
        overlap = longest + 4 * (int(self.budgets.max()) + 1) + self.q
        width = max(WINDOW_BYTES, 4 * overlap)
        group, size = [], 0
        for d, text in enumerate(texts):
            for start in range(0, max(len(text) - overlap, 1), width - overlap):
                stretch = text[start : start + width]
                if group and size + len(stretch) > width:
                    yield group
                    group, size = [], 0
                group.append((d, start, stretch))
                size += len(stretch)
        if group:
            yield group

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, end of the stretch): the best occurrence of each item in each document."""
        if not self.ids:
            return []
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for group in self.windows(texts):
            for w, i, edits, end in self._search([stretch for _, _, stretch in group]):
                d, offset, _ = group[w]
                if (edits, offset + end) < best.get((d, i), (edits + 1, 0)):
                    best[d, i] = edits, offset + end
        return [(d, i, *found) for (d, i), found in sorted(best.items())]

    def _search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        lengths = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(lengths) - lengths
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, low in self.regions(b"\0".join(texts), starts):
            k, item, text = int(self.budgets[i]), self.texts[i], texts[d]
            high = low + 2 * k + 1
            if best.get((d, i), (k, 0))[0] == 0 and (d, i) in best:
                continue
            begin = max(0, low)
            region = text[begin : max(begin, high + len(item))]
            edits, end = distance(item, region, low - begin, high - begin, k)
            if edits <= k and (edits, begin + end) < best.get((d, i), (k + 1, 0)):
                best[d, i] = edits, begin + end
        return [(d, i, *found) for (d, i), found in sorted(best.items())]


class Block:
    """A part of the benchmark: one :class:`Index` per width of gram its items need."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, q: int):
        by: dict[int, list[tuple[int, bytes]]] = {}
        for item in items:
            by.setdefault(gram_width(len(item[1]), rate, q), []).append(item)
        self.indexes = [Index(by[w], rate, w) for w in sorted(by)]

    def search(self, texts: list[bytes]) -> list[tuple]:
        """(document, item id, bytes of the item, edits, end of the stretch), best occurrence of each item."""
        return [
            (d, index.ids[i], len(index.texts[i]), edits, end)
            for index in self.indexes
            for d, i, edits, end in index.search(texts)
        ]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float, q: int) -> Iterator[Block]:
    """Parts of the benchmark, :data:`BLOCK_BYTES` of text each (but for one item)."""
    items: list[tuple[int, bytes]] = []
    size = 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        text = normalise(row[1])
        if not text:
            continue
        if items and size + len(text) > BLOCK_BYTES:
            yield Block(items, rate, q)
            items, size = [], 0
        items.append((row[0], text))
        size += len(text)
    yield Block(items, rate, q)


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    rate: float = RATE,
    q: int = Q,
) -> DataFrame:
    """(id, item_id, edits, similarity, passage): every item found in every whole text, its best occurrence.

    ``similarity`` is one less the edits over the item's bytes, ``passage`` the stretch's last bytes
    as long as the item, normalised.
    """
    spark = df.sparkSession
    bound_batches(spark)
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("item_id", benchmark.schema[item_col].dataType),
            T.StructField("edits", T.IntegerType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("passage", T.StringType()),
        ]
    )
    item_type = pa.int64() if schema["item_id"].dataType in (T.LongType(), T.IntegerType()) else pa.string()
    out = None
    for block in blocks(benchmark, item_col, "text", rate, q):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_BYTES of text, whatever the tables

        def run(batches, shared=shared):
            for part in slices(batches):
                texts = [normalise(x) for x in part.column(1).to_pylist()]
                found = shared.value.search(texts)
                if not found:
                    continue
                ids = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                spans = [texts[d][max(0, end - m) : end] for d, _, m, _, end in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([f[1] for f in found], item_type),
                        pa.array([f[3] for f in found], pa.int32()),
                        pa.array([1.0 - k / m for _, _, m, k, _ in found], pa.float64()),
                        pa.array([s.decode("utf-8", "ignore") for s in spans], pa.string()),
                    ],
                    [f.name for f in schema],
                )

        part = df.select(id_col, text_col).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Rows of ``df`` whose text holds no item; each block of the benchmark filters what the last one left."""
    spark = df.sparkSession
    bound_batches(spark)
    for block in blocks(benchmark, item_col, "text", RATE, Q):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_BYTES of text, whatever the tables
        df = keep_rows(df, text_col, lambda texts, shared=shared: _free(shared.value, texts))
    return df


def _free(block: Block, texts: list[str | None]) -> list[bool]:
    bad = {found[0] for found in block.search([normalise(x) for x in texts])}
    return [i not in bad for i in range(len(texts))]
