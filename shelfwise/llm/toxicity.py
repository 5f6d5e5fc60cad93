"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence with a feature has probability ``sigmoid(bias + weights of its words and word beginnings)``,
a document the noisy-or of these sentences and of one leak, the chance that no sentence explains (so
a long clean text is no likelier toxic than a short one). All are trained on document labels alone
and then say which sentences offend. The features are chosen by Spark over a bounded sample of labelled documents
(those whose document frequency differs between the classes beyond chance), and training sees of
each sentence only the chosen ones.

Empty and null texts have no sentence and score the leak. With no learned rows of both classes every
score is 0. Repeated rows get equal results, an empty table gives no rows, extra columns are
ignored; a document with several labels counts as toxic if one says so.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import Recent, bound_batches, in_fold, one_text_per_id, slices
from shelfwise.session import materialize

FOLDS, HELD_OUT = 5, 0
#: labelled documents of each class that the model is trained on at most
TRAIN_DOCS = 3000
#: features kept at most, and documents one must occur in; their significance in standard errors
FEATURES, SUPPORT, SIGNIFICANT = 20_000, 4, 4.0
PREFIXES = (3, 4, 5)
STEPS, RATE, RIDGE = 300, 0.1, 1e-4
MEMO = 100_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings (marked, so that they differ from words)."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) >= k]]


class Model:
    """Weights, bias and leak; score and offending sentences of a text."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.memo: Recent | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """Noisy-or of the sentences; (index, probability) of those that alone make 0.5."""
        if self.memo is None:
            self.memo = Recent(self.word, MEMO)
        text = (text or "").lower()
        left, found = 1.0 - self.leak, []
        if any(map(self.memo.__getitem__, WORD.findall(text))):
            for i, sentence in enumerate(sentences(text)):
                z = sum(map(self.memo.__getitem__, set(WORD.findall(sentence))))
                if z:
                    p = _sigmoid(self.bias + z)
                    left *= 1.0 - p
                    if p >= 0.5:
                        found.append((i, p))
        return 1.0 - left, found


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.findall(text) if not s.isspace()]


def _sigmoid(z: float) -> float:
    return float(1.0 / (1.0 + np.exp(-min(max(z, -60.0), 60.0))))


def labelled(df: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text): of each class the ``per_class`` labelled rows outside the held-out fold whose ids hash lowest."""
    known = labels.filter(~in_fold("doc_id", FOLDS, HELD_OUT) & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max(label).alias("y"))
    lowest = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    rows = texts.join(F.broadcast(lowest[0].union(lowest[1])), "id")  # 2 * per_class rows
    return one_text_per_id(rows).select("id", "y", "text")


def choose_features(sample: DataFrame) -> list[str]:
    """Features whose document frequencies in the two classes differ beyond chance, strongest first."""
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        for part in slices(batches):
            counts: dict[tuple[str, int], int] = {}
            for y, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                for f in {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}:
                    counts[f, y] = counts.get((f, y), 0) + 1
            if counts:
                features, ys = zip(*counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(features, pa.string()), pa.array(ys, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                    ["feature", "y", "n"],
                )

    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return []
    n0, n1 = float(totals[0]), float(totals[1])
    a, b = F.col("a"), F.col("b")  # documents with the feature: toxic, clean
    share = (a + b + 1) / F.lit(n0 + n1 + 2)
    z = (a / n1 - b / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    rows = (
        sample.mapInArrow(count, schema)
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
        .filter(a + b >= SUPPORT)
        .select("feature", F.abs(z).alias("z"))
        .filter(F.col("z") >= SIGNIFICANT)
        .orderBy(F.desc("z"), "feature")
        .limit(FEATURES)
        .collect()
    )
    return [r["feature"] for r in rows]


def fit(documents: list[tuple[int, list[list[int]]]], size: int, weights_by_class: dict[int, float]) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak by gradient steps on the noisy-or likelihood of document labels.

    ``documents``: (label, features of each sentence that has one).
    """
    n = len(documents)
    y = np.array([d[0] for d in documents], float)
    weight = np.array([weights_by_class[d[0]] for d in documents])
    weight /= weight.sum()
    doc_of = np.array([i for i, d in enumerate(documents) for _ in d[1]], np.int64)
    bags = [s for d in documents for s in d[1]]
    of = np.repeat(np.arange(len(bags)), [len(s) for s in bags])
    feature = np.array([f for s in bags for f in s], np.int64)
    if not len(feature):
        return np.zeros(size), -60.0, float((weight * y).sum())
    w = np.zeros(size + 2)  # the features, the bias, the leak's logit
    w[size:] = -4.0
    m, v = np.zeros(size + 2), np.zeros(size + 2)
    for step in range(1, STEPS + 1):
        z = w[size] + np.bincount(of, w[feature], minlength=len(bags))
        total = np.bincount(doc_of, np.logaddexp(0, z), minlength=n) + np.logaddexp(0, w[-1])
        # slope of the loss in the summed -log(1 - p): 1 for clean, -1 / (e^total - 1) for toxic documents
        slope = weight * np.where(y == 1, -1.0 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
        dz = slope[doc_of] / (1 + np.exp(-z))
        g = np.concatenate([np.bincount(feature, dz[of], minlength=size), [dz.sum(), slope.sum() / (1 + np.exp(-w[-1]))]])
        g[:size] += RIDGE * w[:size]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[size]), _sigmoid(w[-1])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = TRAIN_DOCS) -> Model:
    """A model from a bounded sample; of its texts only sentences' chosen features reach the driver."""
    spark = df.sparkSession
    bound_batches(spark)
    sample = materialize(labelled(df, labels, "toxic", per_class, id_col, text_col).withColumn("y", F.col("y").cast("int")), "toxicity-sample")
    sample = sample.repartition(max(8, spark.sparkContext.defaultParallelism))
    features = choose_features(sample)
    if not features:
        return Model({}, -60.0, 0.0)
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(features)})
    schema = T.StructType(
        [
            T.StructField("y", T.IntegerType()),
            T.StructField("sentences", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )

    def bags(batches):
        at = place.value
        for part in slices(batches):
            found = []
            for text in part.column(2).to_pylist():
                own = [
                    [at[f] for w in set(WORD.findall(x)) for f in word_features(w) if f in at] for x in sentences(text.lower())
                ]
                found.append([x for x in own if x])
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(found, pa.list_(pa.list_(pa.int32())))], [f.name for f in schema]
            )

    documents = [(r["y"], r["sentences"]) for r in sample.mapInArrow(bags, schema).collect()]
    known = labels.filter(~in_fold("doc_id", FOLDS, HELD_OUT)).groupBy("toxic").count().collect()
    real = {r["toxic"]: r["count"] for r in known}
    drawn = {y: sum(d[0] == y for d in documents) for y in (0, 1)}
    w, bias, leak = fit(documents, len(features), {y: real.get(y, 1) / max(drawn[y], 1) for y in (0, 1)})
    return Model({f: float(x) for f, x in zip(features, w) if abs(x) > 1e-3}, bias, leak)


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, offending): score of every whole text, and indexes of its offending sentences."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most
    schema = T.StructType(
        [df.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(T.IntegerType()))]
    )

    def run(batches):
        for part in slices(batches):
            found = [shared.value.score(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([min(max(p, 0.0), 1.0) for p, _ in found], pa.float64()),
                    pa.array([[i for i, _ in s] for _, s in found], pa.list_(pa.int32())),
                ],
                [f.name for f in schema],
            )

    return df.select(id_col, text_col).mapInArrow(run, schema)
