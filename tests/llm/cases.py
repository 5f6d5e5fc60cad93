"""Rows that every operator must handle, with extra columns named like the operators' own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("fp", "words", "n_tokens", "score", "slot", "id", "y", "kind")],
    ]
)

SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil strange soup near the old river"

TEXTS = [
    SENTENCE,
    None,
    "",
    " \t\r\n\x0b\x0c ",
    "one",
    "A B c",
    SENTENCE.upper(),
    SENTENCE,  # a copy
    "naïve Straße 日本語　テスト 🙂 ½  x \x1c\x1f y",
    "line one is here\nline one is here\nline one is here\nother",
    "very " * 3000 + "long",
    "x" * 20000,
    "special <|endoftext|> string<|endoftext|><|endoftext|>",
]


def documents(spark, texts=TEXTS, first=0, lang="en"):
    rows = [(first + i, x, lang, None, None, *["clash"] * 8) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def with_odd_ids(spark):
    """The texts, with a repeated row and a null id."""
    rows = documents(spark)
    more = [(0, SENTENCE, "en", None, None, *["clash"] * 8), (None, "a text without an id", None, None, None, *["clash"] * 8)]
    return rows.union(spark.createDataFrame(more, DOCUMENTS))


def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")
