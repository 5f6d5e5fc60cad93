"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good, the unlabelled are web documents without a label;
documents labelled bad are not learned from. The class prior among the unlabelled is estimated,
and a logistic model over binned text measures minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

on a bounded sample. Only measures (a few numbers a document) of the sample reach the driver.

Empty and null texts are scored like any text (all measures 0). With no positives or no
unlabelled rows to learn from, every score is the prior 0.5. Repeated rows get equal results, an
empty table gives no rows, extra columns are ignored; a document with several labels is a
positive if all say so.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import bound_batches, in_fold, one_text_per_id, slices
from shelfwise.session import materialize

FOLDS, HELD_OUT = 5, 0
#: trusted positives, and unlabelled documents, that the model is trained on at most
TRAIN_DOCS = 8000
BINS = 8
STEPS, RATE = 800, 0.05
#: penalty on squared weights, as so many rows' worth
RIDGE = 0.05
#: standard errors added to the prior's bound
MARGIN = 0.5
SYMBOLS = b"#*$%&|<>@^~{}[]=+\\/_"
MEASURES = (
    "length", "upper", "digits", "symbols", "stops", "shouts", "white", "lines", "entropy", "packed",
    "word_length", "distinct", "same_as_last", "pairs", "dup_lines", "line_length", "marked_words",
)


def measures(text: str | None) -> list[float]:
    """The numbers a text is judged by; all 0 for an empty one."""
    data = (text or "").encode("utf-8")
    n = len(data)
    words = data.split()
    k = len(words)
    if not k:
        return [0.0] * len(MEASURES)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = hist[hist > 0] / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = hist[65:91].sum() + hist[97:123].sum() + hist[128:192].sum()
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(n)),
        float((hist[65:91].sum() + hist[128:159].sum()) / max(letters, 1)),
        float(hist[48:58].sum() / n),
        float(hist[list(SYMBOLS)].sum() / n),
        float(hist[list(b".,;:")].sum() / k),
        float(hist[list(b"!?")].sum() / k),
        float(hist[list(b" \t\n\r\x0b\x0c")].sum() / n),
        len(lines) / k,
        float(-(share * np.log(share)).sum()),
        len(zlib.compress(data, 1)) / n,
        sum(map(len, words)) / k,
        float(np.log1p(kinds) / np.log1p(k)),
        sum(map(bytes.__eq__, words, words[1:])) / k,
        pairs / max(k - 1, 1),
        1.0 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(w[-1] in SYMBOLS for w in words) / k,
    ]


def measured(texts: list[str | None]) -> np.ndarray:
    return np.array([measures(x) for x in texts]).reshape(-1, len(MEASURES))


class Model:
    """One weight per bin of each measure; scores are probabilities of being good."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def logits(self, x: np.ndarray) -> np.ndarray:
        return design(x, self.edges) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(x), 0.5)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def design(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins of every measure."""
    out = np.zeros((len(x), edges.shape[0] * (edges.shape[1] + 1)))
    rows = np.arange(len(x))
    for j, e in enumerate(edges):
        out[rows, j * (edges.shape[1] + 1) + np.searchsorted(e, x[:, j], side="right")] = 1.0
    return out


def _adam(gradient, size: int) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled.

    A classifier tells positives from unlabelled rows; above a cut of its score the unlabelled
    hold at least ``prior`` times the positives' share, with equality where no negative is left,
    so the least ratio over cuts (with a one-sided error margin) bounds the prior. Each half of
    the rows is judged by the classifier of the other half.
    """
    found = []
    for half in (0, 1):
        own_p, own_u, p_, u_ = p[half::2], u[half::2], p[1 - half :: 2], u[1 - half :: 2]
        if not (len(own_p) and len(own_u) and len(p_) and len(u_)):
            return 0.5
        x = np.vstack([p_, u_])
        y = np.concatenate([np.ones(len(p_)), np.zeros(len(u_))])
        each = np.where(y == 1, 0.5 / len(p_), 0.5 / len(u_))
        w = _adam(lambda w: x.T @ (each * (_sigmoid(x @ w) - y)) + RIDGE / len(x) * w, x.shape[1])
        sp, su = own_p @ w, own_u @ w
        best = 1.0
        for cut in np.quantile(sp, np.linspace(0.0, 0.6, 25)):
            of_p, of_u = (sp >= cut).mean(), (su >= cut).mean()
            margin = MARGIN * np.sqrt(of_u * (1 - of_u) / len(su) + of_p * (1 - of_p) / len(sp)) / max(of_p, 1e-9)
            best = min(best, of_u / max(of_p, 1e-9) + margin)
        found.append(best)
    return float(min(max(np.mean(found), 0.05), 0.98))


def fit(positives: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Minimise the non-negative risk; where the negative part falls below 0 it is stepped back."""
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros((0, 0)), np.zeros(0), 0.0, 0.5)
    both = np.vstack([positives, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    # the outer tails, where junk lies, get bins of their own
    edges = np.sort(np.hstack([edges, np.quantile(both, [0.01, 0.03, 0.97, 0.99], axis=0).T]), axis=1)
    p, u = (np.hstack([design(x, edges), np.ones((len(x), 1))]) for x in (positives, unlabelled))
    prior = estimate_prior(p, u)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        good = prior * (p.T @ (_sigmoid(zp) - 1)) / len(p)
        bad_p, bad_u = (p.T @ _sigmoid(zp)) / len(p), (u.T @ _sigmoid(zu)) / len(u)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rest = bad_u - prior * bad_p
        return (good + rest if risk >= 0 else -rest) + RIDGE / len(u) * w

    w = _adam(gradient, p.shape[1])
    return Model(edges, w[:-1], float(w[-1]), prior)


def _measured(df: DataFrame) -> DataFrame:
    """(kind, m) of rows (kind, text)."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("m", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for part in slices(batches):
            values = [measures(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.list_(pa.float64()))], ["kind", "m"])

    return df.mapInArrow(run, schema)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = TRAIN_DOCS) -> Model:
    """A model from at most ``docs`` positives and ``docs`` unlabelled texts, lowest id hashes first."""
    spark = df.sparkSession
    bound_batches(spark)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("y"))
    ids = df.filter(~in_fold(id_col, FOLDS, HELD_OUT)).select(F.col(id_col).alias("id")).distinct().join(known, "id", "left")
    kinds = [
        ids.filter(c).select("id", F.lit(k).alias("kind")).orderBy(F.xxhash64("id"), "id").limit(docs)
        for k, c in ((1, F.col("y") == 1), (0, F.col("y").isNull()))
    ]
    chosen = F.broadcast(kinds[0].union(kinds[1]))  # 2 * docs rows
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    texts = one_text_per_id(texts).select("kind", "text")
    rows = materialize(_measured(texts), "quality-sample").collect()
    by = {k: np.array([r["m"] for r in rows if r["kind"] == k]).reshape(-1, len(MEASURES)) for k in (0, 1)}
    # in one order whatever the partitions, and shuffled, since halves of the rows are compared
    ordered = [x[np.lexsort(x.T)][np.random.default_rng(0).permutation(len(x))] for x in (by[1], by[0])]
    return fit(*ordered)


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    bound_batches(df.sparkSession)
    schema = T.StructType([df.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches):
        for part in slices(batches):
            scores = model.scores(measured(part.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
