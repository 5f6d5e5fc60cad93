"""Language identification with interpolated Kneser-Ney character models, one per language.

A text is a bag of words (runs of letters, lower-cased) and a model gives each word, between
word marks, a probability from its characters; no context crosses a mark. Models are trained on
a bounded sample of labelled texts: Spark counts the sample's n-grams, and the discounted,
interpolated probabilities of all languages are kept in hash arrays, sorted, one row of log
probabilities per n-gram. The language of the lowest cross-entropy per character wins.

Rejection is calibrated: a text whose cross-entropy is above what ``1 - REJECT`` of the training
texts of its language reach is marked ``rejected`` (the prediction stays).

Null texts and texts without a letter are ``und`` with score 0. With nothing to learn from,
every text is ``und``. Ties go to the language first in order. Repeated rows get equal results,
an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfwise.llm.common import bound_batches, in_fold, one_text_per_id, slices
from shelfwise.session import broadcast_if_small, materialize

ORDER = 4
#: labelled texts per language that models are trained on at most
TRAIN_DOCS = 1000
#: parts a language's ids are ranked in before they are ranked together
SALTS = 64
DISCOUNT = 0.75
REJECT = 0.005
#: words a worker remembers, their letters at most, and words looked up together
MEMO, MEMO_LETTERS, PART = 250_000, 4_000_000, 4096
FOLDS, HELD_OUT = 4, 2
MARK = "\x02"
_WORDLIKE = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: str) -> list[str]:
    """Lower-cased runs of letters (Unicode categories L); numerals such as ½ or Ⅷ are none."""
    words = _WORDLIKE.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return " ".join("".join(c if c.isalpha() else " " for c in w) for w in words).split()


def hashed(codes: np.ndarray, width: int, ends: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of windows of ``width`` character codes: all, or those whose last places are ``ends``."""
    if ends is None:
        ends = np.arange(width - 1, len(codes))
    h = np.full(len(ends), width, np.uint64)
    for j in range(width):
        h = (h ^ codes[ends - (width - 1 - j)]) * _BASE
        h ^= h >> np.uint64(29)
    return h


class Models:
    """Log probabilities of all languages, per order one sorted array of n-gram hashes."""

    def __init__(self, langs: list[str], counts: dict[tuple[str, str], int]):
        """``counts``: (language, n-gram of :data:`ORDER` characters) -> occurrences in the sample."""
        self.langs = langs
        per: list[list[dict[str, int]]] = []
        for lang in langs:
            top = defaultdict(int)
            for (of, gram), n in counts.items():
                if of == lang:
                    top[gram] += n
            orders = [dict(top)]
            for _ in range(ORDER - 1):  # lower orders count the different characters before them
                lower = defaultdict(int)
                for gram in orders[0]:
                    lower[gram[1:]] += 1
                orders.insert(0, dict(lower))
            per.append(orders)
        alphabet = len({g for orders in per for g in orders[0]}) + 1
        self.hashes: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        below: list[dict[str, float]] = [{} for _ in langs]
        for width in range(1, ORDER + 1):
            grams = sorted({g for orders in per for g in orders[width - 1]})
            table = np.zeros((len(grams), len(langs)))
            contexts = sorted({g[:-1] for g in grams})
            weights = np.zeros((len(contexts), len(langs)))
            place = {c: i for i, c in enumerate(contexts)}
            for k, orders in enumerate(per):
                total, kinds = defaultdict(int), defaultdict(int)
                for g, n in orders[width - 1].items():
                    total[g[:-1]] += n
                    kinds[g[:-1]] += 1
                for c, i in place.items():
                    # an unseen context leaves the whole mass to the shorter one
                    weights[i, k] = DISCOUNT * kinds[c] / total[c] if total[c] else 1.0
                now = {}
                for i, g in enumerate(grams):
                    lower = self._lower(below[k], g[1:], 1.0 / alphabet) if width > 1 else 1.0 / alphabet
                    c = g[:-1]
                    p = max(orders[width - 1].get(g, 0) - DISCOUNT, 0) / total[c] if total[c] else 0.0
                    now[g] = table[i, k] = p + weights[place[c], k] * lower
                below[k] = now
            self._add(grams, np.log(table), self.hashes, self.logs, width)
            self._add(contexts, np.log(weights), self.contexts, self.backoff, width - 1)
        # a character no training text has: what single characters leave over, spread evenly
        self.floor = self.backoff[0][0] - np.log(alphabet) if len(self.backoff[0]) else np.zeros(len(langs))
        self.thresholds = np.full(len(langs), np.inf)
        self.scale = 1.0
        self.memo: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None, "rows": None}

    @staticmethod
    def _lower(table: dict[str, float], gram: str, uniform: float) -> float:
        return table.get(gram, uniform)

    @staticmethod
    def _add(grams: list[str], values: np.ndarray, keys: list, tables: list, width: int) -> None:
        codes = np.array([[ord(c) for c in g] for g in grams], np.uint64).reshape(len(grams), width)
        h = np.full(len(grams), width, np.uint64)
        for j in range(width):
            h = (h ^ codes[:, j]) * _BASE
            h ^= h >> np.uint64(29)
        order = np.argsort(h)
        keys.append(h[order])
        tables.append(values[order])

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words, a row each and a column per language: each character given up to three before it."""
        text = "".join([MARK * (ORDER - 1) + w + MARK for w in words])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        # places of the characters to be answered: all but the marks before each word
        ends = np.arange(int(sizes.sum())) + np.repeat((ORDER - 1) * np.arange(1, len(words) + 1), sizes)
        logs = np.zeros((len(ends), len(self.langs)))
        open_ = np.arange(len(ends))  # not answered yet
        for width in range(ORDER, 0, -1):
            at, hit = self._find(self.hashes[width - 1], hashed(codes, width, ends[open_]))
            logs[open_[hit]] += self.logs[width - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            if width > 1:  # unseen: the weight of the context, then a shorter one
                at, hit = self._find(self.contexts[width - 1], hashed(codes, width - 1, ends[open_] - 1))
                logs[open_[hit]] += self.backoff[width - 1][at[hit]]
        logs[open_] += self.floor
        return np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0)

    def word(self, word: str) -> np.ndarray:
        return self.words([word])[0]

    def known(self, words: list[str]) -> np.ndarray:
        """The same through a bounded memo; only words it lacks are looked up, all at once."""
        if self.memo is None:
            self.memo, self.rows, self.letters = np.zeros((MEMO, len(self.langs))), {}, 0
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if new:
            letters = sum(map(len, new))
            if len(self.rows) + len(new) > MEMO or self.letters + letters > MEMO_LETTERS:
                self.rows, self.letters, new = {}, 0, list(dict.fromkeys(words))
                letters = sum(map(len, new))
            first = len(self.rows)
            self.memo[first : first + len(new)] = self.words(new)
            self.rows.update(zip(new, range(first, first + len(new))))
            self.letters += letters
        return self.memo[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def entropy(self, text: str | None) -> np.ndarray | None:
        """Nats a character per language; None without a letter."""
        words = letter_runs(text or "")
        if not words or not self.langs:
            return None
        total = np.zeros(len(self.langs))
        for start in range(0, len(words), PART):
            total += self.known(words[start : start + PART]).sum(axis=0)
        return -total / (sum(map(len, words)) + len(words))

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score from 0 to 1, cross-entropy, rejected."""
        h = self.entropy(text)
        if h is None:
            return "und", 0.0, None, True
        best = int(np.argmin(h))
        score = 1.0 / float(np.exp(np.minimum((h[best] - h) * self.scale, 0)).sum())
        return self.langs[best], score, float(h[best]), bool(h[best] > self.thresholds[best])

    def calibrate(self, entropies: list[tuple[str, list[float]]]) -> None:
        """Rejection thresholds and the sharpness of the score, from training texts."""
        for k, lang in enumerate(self.langs):
            own = [h[k] for of, h in entropies if of == lang]
            if own:
                self.thresholds[k] = float(np.quantile(own, 1 - REJECT))
        gaps = [np.partition(h, 1)[1] - min(h) for _, h in entropies if len(h) > 1]
        if gaps:
            self.scale = 4.0 / max(float(np.median(gaps)), 1e-3)


def training_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """(lang, text): of each language the ``per_lang`` training texts whose ids hash lowest, one text an id."""
    ids = df.filter(~in_fold(id_col, FOLDS, HELD_OUT) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang")
    ).distinct()  # an id counts once, however often it repeats
    # top k per language: first of each salted part, so that no task ranks a common language alone
    order = F.xxhash64("id")
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "id"))
        ids = ids.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS))).withColumn("r", rank).filter(F.col("r") <= per_lang)
    chosen = ids.select("id").distinct()
    rows = (
        df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .filter("text IS NOT NULL AND lang IS NOT NULL")
        .join(broadcast_if_small(chosen), "id", "left_semi")  # per_lang rows a language
    )
    return one_text_per_id(rows).select("lang", "text")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_DOCS) -> Models:
    """Models from a bounded sample; only its n-gram counts and entropies reach the driver."""
    spark = df.sparkSession
    bound_batches(spark)
    sample = materialize(training_sample(df, id_col, text_col, lang_col, per_lang), "language-sample")
    sample = sample.repartition(max(8, spark.sparkContext.defaultParallelism))
    gram = T.StructType([sample.schema["lang"], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches):
        counts: dict[tuple[str, str], int] = defaultdict(int)
        for part in slices(batches):
            words: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for w in letter_runs(text):
                    words[lang, w] += 1
            for (lang, w), n in words.items():
                padded = MARK * (ORDER - 1) + w + MARK
                for i in range(len(padded) - ORDER + 1):
                    counts[lang, padded[i : i + ORDER]] += n
        if counts:
            langs, grams = zip(*counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(list(counts.values()), pa.int64())],
                [f.name for f in gram],
            )

    rows = sample.mapInArrow(count, gram).groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    counts = {(r["lang"], r["gram"]): r["n"] for r in rows}
    models = Models(sorted({lang for lang, _ in counts}), counts)
    shared = spark.sparkContext.broadcast(models)
    schema = T.StructType([sample.schema["lang"], T.StructField("h", T.ArrayType(T.DoubleType()))])

    def measure(batches):
        for part in slices(batches):
            h = [shared.value.entropy(x) for x in part.column(1).to_pylist()]
            values = pa.array([None if x is None else x.tolist() for x in h], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), values], ["lang", "h"])

    measured = sample.mapInArrow(measure, schema).filter("h IS NOT NULL").collect() if models.langs else []
    models.calibrate([(r["lang"], r["h"]) for r in measured])
    return models


def identify(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, entropy, rejected) of every whole text."""
    bound_batches(df.sparkSession)
    # n-grams of at most TRAIN_DOCS texts a language
    shared = df.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("entropy", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )

    def run(batches):
        for part in slices(batches):
            found = list(zip(*map(shared.value.predict, part.column(1).to_pylist())))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], [f.name for f in schema])

    return df.select(id_col, text_col).mapInArrow(run, schema)
