"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is tested: it is *proven* if it is valid UTF-8, is one
pre-token on its own, and its merges end in exactly one token. A pre-token that is a proven
string counts one without merging; only the rest are merged.

Null text counts as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows, ties and
clashing extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfwise.llm.bpe import MEMO, Vocabulary, pre_tokens
from shelfwise.llm.common import Recent, bound_batches, slices


def proven_tokens(vocab: Vocabulary) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token."""
    found = set()
    for piece in vocab.pieces.values():
        try:
            text = piece.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if pre_tokens(text) == [text] and len(vocab.merge(piece)) == 1:
            found.add(text)
    return frozenset(found)


class Counter:
    """Tokens of a text; proven strings cost one lookup."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.proven = vocab, proven_tokens(vocab)
        self.counts: Recent | None = None

    def __getstate__(self):
        return self.__dict__ | {"counts": None}

    def one(self, token: str) -> int:
        return 1 if token in self.proven else len(self.vocab.merge(token.encode("utf-8")))

    def count(self, text: str) -> int:
        if self.counts is None:
            self.counts = Recent(self.one, MEMO)
            self.counts.update(dict.fromkeys(self.proven, 1))
        return sum(
            1 if special else sum(map(self.counts.__getitem__, pre_tokens(part)))
            for special, part in self.vocab.parts(text)
        )


def count_tokens(
    df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Counter(Vocabulary(vocabulary)))
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batches):
        counter = shared.value
        for part in slices(batches):
            texts = [x or "" for x in part.column(1).to_pylist()]
            counts = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x.encode("utf-8")) for x in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                [f.name for f in schema],
            )

    return df.select(id_col, text_col).mapInArrow(run, schema)
