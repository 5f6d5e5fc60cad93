"""The stored search index: which names hold a word.

Built from the products when a snapshot version is written, and anew only for the parts a batch
touches; searches read it and tokenise nothing. Postings are sorted by word and name within range
partitions, so a word that very many names hold lies in several files and row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import tokens_of

INDEX_TABLES = {
    "names": "name_id bigint, normalized_name string, category string",
    "postings": "word string, name_id bigint",
    "vocabulary": "word string, names_with bigint",
}


@dataclass(frozen=True)
class SearchIndex:
    #: distinct (search name, category) pairs
    names: DataFrame
    #: (word, name_id) of every word of every name
    postings: DataFrame
    #: every word with the number of names that hold it
    vocabulary: DataFrame
    #: one name or word may stand in several parts
    several_parts: bool = False


def names_of(products: DataFrame, *keys: str) -> DataFrame:
    names = products.select(*keys, "normalized_name", "category").distinct()
    return names.select(*keys, F.xxhash64("normalized_name", "category").alias("name_id"), "normalized_name", "category")


def postings_of(names: DataFrame, *keys: str) -> DataFrame:
    words = F.explode(F.array_distinct(tokens_of(F.col("normalized_name"))))
    return names.select(*keys, words.alias("word"), "name_id")


def vocabulary_of(postings: DataFrame, *keys: str) -> DataFrame:
    return postings.groupBy(*keys, "word").agg(F.count("*").alias("names_with"))


def build_index(products: DataFrame) -> SearchIndex:
    """An index that is not stored, for a catalogue that has none yet."""
    names = names_of(products)
    postings = postings_of(names)
    return SearchIndex(names, postings, vocabulary_of(postings))
