"""Near-duplicate vectors by sorted projection passes.

Every vector gets a sketch of sign bits of random projections. A pass orders all vectors
lexicographically by a concatenation of randomly chosen sketch bits and compares each with a bounded
window of neighbours in that order; passes differ in the bits they sort by, and the pairs they verify
are united. Close vectors agree in a bit with probability ``1 - angle / pi``, so they share the first
``log2(rows / window)`` bits, and with them a window, with a known probability a pass; the number of
passes follows from it and from the number of rows (:func:`passes_for`), so recall is the same at every
size. The order is cut into blocks of equal length that overlap by a window: no key, copy or group is
ever gathered in one task, and no pair of neighbours is lost at a cut.

Within a block pairs are judged by sketch distance; only pairs that may be links are looked up and
verified by cosine in double precision. Pairs whose sketches leave little doubt join a block's vectors
into a spanning forest instead of being listed one by one, so a very large group of near copies makes
as many candidates as it has vectors, not as it has pairs. That loses no link: inside the components
that the verified pairs give, all links are counted exactly. A vector at angle ``a`` from its
component's pivot and one at angle ``b`` are surely linked if ``a + b`` is below the threshold's angle,
which a histogram of angles counts without making pairs; only pairs it cannot decide are computed, as
products of blocks of bounded size.

Exact copies are one class from the start and count by their number. Vectors that are null, empty, zero
or hold null or non-finite components link with nothing; vectors of different length never link.
Repeated rows are copies of each other. A null id names a component only if it has no other, and is
kept only then. An empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import bound_batches, slices
from shelfwise.llm.simhash import components
from shelfwise.operators.keyed import assign_ids
from shelfwise.session import broadcast_if_small, materialize

#: sign bits of a sketch, and how many of them a pass sorts by
SKETCH_BITS = 256
KEY_BITS = 62
#: neighbours each vector is compared with on either side
WINDOW = 32
#: rows of a block; a window more of the next block is added
BLOCK = 4096
#: share of pairs just at the threshold that the passes must meet
RECALL = 0.95
#: standard deviations by which a sketch distance may lie above what the threshold's angle gives
SLACK = 4
#: vectors on one side of a product of blocks
TILE = 1024
#: bins of the angle between a vector and its pivot, over half a turn
BINS = 4096


def passes_for(rows: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has shared a window with probability ``recall``."""
    agree = 1 - math.acos(threshold) / math.pi
    meet = agree ** max(0.0, math.log2(max(rows, 1) / window))
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def usable(vector) -> np.ndarray | None:
    """The vector scaled to length one, in double precision; None if it can link with nothing."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top  # neither overflow nor underflow in the norm
    return v / np.sqrt(v @ v)


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([42, dim]).standard_normal((dim, SKETCH_BITS))


def _unit_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, digest, unit): unit vector as bytes, and SHA-256 of it; both null where nothing can link."""
    bound_batches(df.sparkSession)
    schema = T.StructType([df.schema[id_col], T.StructField("digest", T.BinaryType()), T.StructField("unit", T.BinaryType())])

    def run(batches):
        for part in slices(batches):
            units = [usable(v) for v in part.column(1).to_pylist()]
            stored = [None if u is None else u.tobytes() for u in units]
            digests = [None if u is None else hashlib.sha256(u).digest() for u in stored]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(digests, pa.binary()), pa.array(stored, pa.binary())], [id_col, "digest", "unit"]
            )

    return df.select(id_col, vec_col).mapInArrow(run, schema)


def _keyed(classes: DataFrame, n_passes: int) -> DataFrame:
    """(pass, dim, key, cls, sketch): one row per class and pass."""
    schema = "pass int, dim int, key bigint, cls bigint, sketch binary"
    chosen = [np.random.default_rng([7, k]).permutation(SKETCH_BITS)[:KEY_BITS] for k in range(n_passes)]
    weights = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for part in slices(batches):
            units = [np.frombuffer(u) for u in part.column(1).to_pylist()]
            dims = np.array([len(u) for u in units], np.int32)
            bits = np.zeros((len(units), SKETCH_BITS), np.uint8)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes = {dim: _planes(dim)}
                bits[at] = np.stack([units[i] for i in at]) @ planes[dim] > 0
            packed = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
            for k, columns in enumerate(chosen):
                keys = bits[:, columns].astype(np.int64) @ weights
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(units), k, np.int32)), pa.array(dims), pa.array(keys), part.column(0), packed],
                    ["pass", "dim", "key", "cls", "sketch"],
                )

    return classes.select("cls", "unit").mapInArrow(run, schema)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the edges between ``n`` rows join two trees, taken in order."""
    root = list(range(n))
    joins = np.zeros(len(left), bool)
    for e, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            joins[e] = True
    return joins


def _neighbours(keyed: DataFrame, threshold: float, window: int, block: int) -> DataFrame:
    """(u, v): distinct pairs of neighbours that may be links, or stand for many that may."""
    placed = assign_ids(keyed, -1, ["pass", "dim", "key", "cls"], "rank")
    here = F.floor(F.col("rank") / block).cast("bigint")
    both = F.when((F.col("rank") % block < window) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    dealt = placed.select("rank", "pass", "dim", "cls", "sketch", F.explode(both).alias("block"))
    expected = SKETCH_BITS * math.acos(threshold) / math.pi
    spread = math.sqrt(expected * (1 - expected / SKETCH_BITS))
    most, sure = expected + SLACK * spread, expected - SLACK * spread

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n = table.num_rows
        words = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(n, -1)
        of = table["pass"].to_numpy().astype(np.int64) << 32 | table["dim"].to_numpy()
        cls, number = table["cls"].to_numpy(), table["block"][0].as_py()
        own = table["rank"].to_numpy() // block == number
        left, right, far = [], [], []
        for step in range(1, min(window, n - 1) + 1):
            bits = np.bitwise_count(words[step:] ^ words[:-step]).sum(axis=1)
            near = np.flatnonzero((bits <= most) & (of[step:] == of[:-step]) & own[:-step])
            left.append(near)
            right.append(near + step)
            far.append(bits[near])
        left, right, far = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right, far))
        order = np.argsort(far, kind="stable")
        left, right, far = left[order], right[order], far[order]
        keep = far > sure
        plain = np.flatnonzero(~keep)
        keep[plain] = _forest(n, left[plain], right[plain])
        a, b = cls[left[keep]], cls[right[keep]]
        return pa.table({"u": np.minimum(a, b), "v": np.maximum(a, b)})

    return dealt.groupBy("block").applyInArrow(compare, "u bigint, v bigint").distinct()


def _dot(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``cosine`` of their unit vectors ``a`` and ``b``, which are dropped."""
    kept = [c for c in pairs.columns if c not in ("a", "b")]
    schema = T.StructType([*[pairs.schema[c] for c in kept], T.StructField("cosine", T.DoubleType(), False)])

    def run(batches):
        for part in slices(batches):
            a, b = part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist()
            cosine = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(cosine, pa.float64())], [*kept, "cosine"])

    return pairs.select(*kept, "a", "b").mapInArrow(run, schema)


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    a = classes.select(F.col("cls").alias("u"), F.col("unit").alias("a"))
    b = classes.select(F.col("cls").alias("v"), F.col("unit").alias("b"))
    return _dot(pairs.join(a, "u").join(b, "v")).filter(F.col("cosine") >= threshold).select("u", "v")


def _links_within(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(cls, linked): vectors linked with each member of a component, itself and its copies included.

    ``members``: materialised (cls, root, weight, bin, unit). Bins are angles from the pivot, rounded
    up: two members are surely linked if their bins together are below the threshold's. Members that
    bins cannot decide meet in tiles; a tile's side holds a bounded number of vectors.
    """
    limit = math.floor(math.acos(threshold) / math.pi * BINS) - 1
    by_bin = members.groupBy("root", "bin").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    upto = by_bin.withColumn("sure", F.sum("weight").over(Window.partitionBy("root").orderBy("bin")))  # at most BINS rows a root
    users = by_bin.select("root", F.col("bin").alias("of"))
    sure = (
        users.join(upto, "root").filter(F.col("of") + F.col("bin") <= limit)  # bins only
        .groupBy("root", "of").agg(F.max("sure").alias("sure")).withColumnRenamed("of", "bin")
    )
    # one component may hold most members: rows per component or bin are sent to them where they are few
    counted = members.select("cls", "root", "bin").join(broadcast_if_small(sure), ["root", "bin"], "left").select(
        "cls", F.coalesce("sure", F.lit(0)).cast("bigint").alias("linked")
    )
    # only a member beyond half the angle can be undecided with another; the other side is all that remain
    wide = members.groupBy("root").agg(F.max("bin").alias("widest"), F.count("*").alias("n")).filter(F.col("widest") * 2 > limit)
    tiles = F.ceil(F.col("n") / tile).cast("int")
    open_ = members.join(broadcast_if_small(wide.select("root", "widest", "n")), "root").filter(F.col("bin") + F.col("widest") > limit)
    open_ = open_.withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("cls"), tiles).cast("int")})
    row = ["root", "cls", "weight", "bin", "unit"]
    across = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = open_.select(*row, F.col("tile").alias("i"), across.alias("j"), F.lit(True).alias("counts"))
    right = open_.select(*row, across.alias("i"), F.col("tile").alias("j"), F.lit(False).alias("counts"))

    def meet(both: pa.Table) -> pa.Table:
        side = both["counts"].combine_chunks()
        a, b = both.filter(side), both.filter(pc.invert(side))
        if not (a.num_rows and b.num_rows):
            return pa.table({"cls": pa.array([], pa.int64()), "linked": pa.array([], pa.int64())})
        x = np.stack([np.frombuffer(u) for u in a["unit"].to_pylist()])
        y = np.stack([np.frombuffer(u) for u in b["unit"].to_pylist()])
        bins = a["bin"].to_numpy()[:, None] + b["bin"].to_numpy()[None, :]
        near = (x @ y.T >= threshold) & (bins > limit)
        same = a["cls"].to_numpy()[:, None] == b["cls"].to_numpy()[None, :]
        return pa.table({"cls": a["cls"], "linked": pa.array((near | same & (bins > limit)) @ b["weight"].to_numpy())})

    met = left.unionByName(right).groupBy("root", "i", "j").applyInArrow(meet, "cls bigint, linked bigint")
    return counted.unionByName(met).groupBy("cls").agg(F.sum("linked").alias("linked"))


def near_duplicate_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.9,
    window: int = WINDOW,
    recall: float = RECALL,
    block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """(id, n_links, component_id, kept): linked vectors, smallest id reachable by links, whether it is one's own."""
    rows = _unit_rows(df, id_col, vec_col)
    grouped = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min(id_col).alias("least"), F.count("*").alias("weight"), F.first("unit").alias("unit")
    )
    classes = materialize(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n_passes = passes_for(classes.count(), threshold, window, recall)
    pairs = materialize(_neighbours(_keyed(classes, n_passes), threshold, window, block), "neighbours")
    found = materialize(_verified(pairs, classes, threshold), "found")
    roots = components(found).withColumnRenamed("fp", "cls")
    placed = classes.join(roots, "cls")
    pivots = classes.select(F.col("cls").alias("root"), F.col("unit").alias("b"))
    angles = _dot(placed.withColumnRenamed("unit", "a").withColumn("unit", F.col("a")).join(broadcast_if_small(pivots.join(roots.select("root").distinct(), "root", "left_semi")), "root"))
    turn = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine")))) / math.pi
    members = materialize(
        angles.select("cls", "root", "least", "weight", F.ceil(turn * BINS).cast("int").alias("bin"), "unit"), "members"
    )
    linked = _links_within(members.drop("least"), threshold, tile)
    names = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = members.join(broadcast_if_small(names), "root").join(linked, "cls").select("cls", "component_id", F.col("linked"))
    of_class = classes.select("cls", "digest", "least", "weight").join(of_class, "cls", "left").select(
        "digest",
        F.coalesce("component_id", "least").alias("component_id"),
        (F.coalesce("linked", "weight") - 1).alias("n_links"),
    )
    placed = rows.drop("unit").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return placed.select(
        id_col, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
