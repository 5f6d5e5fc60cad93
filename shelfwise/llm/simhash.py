"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints at most four bits apart
differ by at most one bit in one of them, so a pair meets under that segment's value (no bit
differs) or under the value with one wildcard bit (exactly that bit differs: one side brings a
0 there, the other a 1). Both are equality joins on distinct fingerprints; the distance is
verified inside the join condition, so only true links leave it.

Copies collapse into one fingerprint before any pairing. A signature that very many distinct
fingerprints share is split again: of five pieces of the whole fingerprint one must be equal,
and its value joins the key, so no link is lost. What is left of skew Spark's adaptive join
splits. Components are found by alternating large-star and small-star steps, each written to the
shared folder.

Null or wordless text has the fingerprint zero and is linked like any other. Repeated rows are
copies. Null ids never name a component unless it has no other. An empty table gives no rows;
extra columns are ignored.

Those settings are op4's; the pipeline's stage is :mod:`shelfwise.llm.near_copies`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import bound_batches, slices
from shelfwise.session import materialize

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (first bit, width) of the segments: with three, one differs by at most ``MAX_BITS // 3`` bits
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: pieces of the second split of crowded signatures: with five, one is equal
PIECES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: distinct fingerprints under one signature from which it is split again
CROWDED = 4096
#: fingerprints looked at to find crowded signatures: one in so many (results do not depend on it)
LOOK = 16
#: words of the pipeline stage's shingles
STAGE_SHINGLE = 5


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words; of all words if there are fewer."""
    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - width + 1)


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of word shingles; a bit needs more than half of them."""
    words = _words(text)
    if not words:
        return 0
    hashes = _hashes(words, SHINGLE)
    if len(hashes) == 1:
        return int(hashes[0])
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        octets = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): signed 64-bit fingerprint of every whole text."""
    bound_batches(df.sparkSession)
    schema = T.StructType([df.schema[id_col], T.StructField("fp", T.LongType(), False)])

    def run(batches):
        for part in slices(batches):
            bits = np.array([fingerprint(x) for x in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _bits(start: int, width: int) -> F.Column:
    return F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def signatures(fps: DataFrame) -> DataFrame:
    """(fp, sig, value, side): segment values (side null) and one-wildcard variants (the bit's value)."""
    variants = []
    for s, (start, width) in enumerate(SEGMENTS):
        segment = _bits(start, width)
        variants.append(F.struct(F.lit(64 + s).alias("sig"), segment.alias("value"), F.lit(None).cast("int").alias("side")))
        for j in range(width):
            bit = F.shiftrightunsigned(segment, j).bitwiseAND(F.lit(1).cast("long"))
            variants.append(
                F.struct(
                    F.lit(start + j).alias("sig"),
                    (segment - F.shiftleft(bit, j)).alias("value"),
                    bit.cast("int").alias("side"),
                )
            )
    return fps.select("fp", F.inline(F.array(*variants)))


def _pairs(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Verified links between rows that share ``keys``."""
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]

    def meet(left: DataFrame, right: DataFrame, *more) -> DataFrame:
        condition = near
        for c in (*same, *more):
            condition = condition & c
        # Spark sizes signatures as if each fingerprint had one of them, and would broadcast all of a table
        left, right = left.hint("merge").alias("a"), right.alias("b")
        return left.join(right, condition).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    exact, wild = keyed.filter("side IS NULL"), keyed.filter("side IS NOT NULL")
    return meet(exact, exact, F.col("a.fp") < F.col("b.fp")).union(meet(wild.filter("side = 0"), wild.filter("side = 1")))


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(u, v): every pair of distinct fingerprints at most ``MAX_BITS`` apart, once, u < v.

    ``fps`` must hold distinct fingerprints and be cheap to read twice.
    """
    sigs = signatures(fps)
    looked = signatures(fps.filter(F.pmod(F.xxhash64("fp"), F.lit(LOOK)) == 0))
    hot = looked.groupBy("sig", "value").count().filter(F.col("count") * LOOK > crowded).select("sig", "value")
    hot = materialize(hot, "crowded")
    if hot.isEmpty():
        found = _pairs(sigs, ["sig", "value"])
    else:
        pieces = [F.struct(F.lit(i).alias("piece"), _bits(a, w).alias("rest")) for i, (a, w) in enumerate(PIECES)]
        split = sigs.join(hot, ["sig", "value"], "left_semi").select("*", F.inline(F.array(*pieces)))
        found = _pairs(sigs.join(hot, ["sig", "value"], "left_anti"), ["sig", "value"]).union(
            _pairs(split, ["sig", "value", "piece", "rest"])
        )
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over (u, v) edges with u < v.

    The minimum of a vertex is a partial aggregate joined back, so a vertex with very many
    neighbours is split by the join and never gathered.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.filter("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.filter("v > u") if large else around
    stepped = moved.join(least, "u")
    out = stepped.select(F.col("m").alias("u"), "v")
    if not large:
        out = out.union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest vertex reachable from each vertex that has a link."""
    now = materialize(edges, "links")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        now = materialize(_star(_star(now, large=True), large=False), "stars")
    return now.select(F.col("v").alias("fp"), F.col("u").alias("root")).union(
        now.select(F.col("u").alias("fp"), F.col("u").alias("root")).distinct()
    )


def _named(copies: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every row of ``copies`` (fp, least), from the ``roots`` of linked ones."""
    linked = copies.join(roots, "fp")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "root").select("fp", "root", "component_id")
    return copies.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")
    )


def groups(docs: DataFrame, id_col: str = "doc_id", crowded: int = CROWDED) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of materialised ``docs`` (id, fp)."""
    copies = materialize(docs.groupBy("fp").agg(F.min(id_col).alias("least")), "copies")
    return _named(copies, components(links(copies.select("fp"), crowded)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(id, fingerprint, component_id): fingerprint as 16 hex digits, smallest id reachable by links."""
    docs = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    return docs.join(groups(docs, id_col, crowded), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text; none of a wordless one."""
    words = _words(text)
    return np.unique(_hashes(words, STAGE_SHINGLE)) if words else np.empty(0, np.uint64)
