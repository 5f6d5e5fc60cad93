"""Trie of conversation prefixes by composable fingerprints.

Conversations may be rebuilt: the first ``head`` turns of another one, the *base*, then their own
turns after the first ``head``. The rebuilt texts are never put together. Every turn is an element
of a monoid, (number of turns, polynomial hash of their digests), and the stored turns carry the
product of all turns before them and up to them, over the whole table in its order. Any stretch of
stored turns is then a difference of two such products, and a rebuilt prefix is the product of a
head of the base and a stretch of its own, computed from a few numbers per row. Products of whole
partitions are combined from one row per partition, so a conversation may be spread over any number
of tasks.

Prefixes with equal depth and fingerprint form a node. A fingerprint has four lanes of 31 bits; each
group then verifies, through the stored turn every row refers to, that the SHA-256 of role and text
of the last turns are equal, and that the groups of the prefixes one turn shorter are; by induction
whole prefixes are equal. Should a group fail, all is done again with other multipliers.

Sums over subtrees: nodes with the same smallest member form a path, since that member's path runs
through all of them. Whole paths are summed, paths add up to the paths they hang on by doubling
(rounds grow with the logarithm of how deeply paths nest, not with the number of turns), and within a
path sums run along its depth in chunks of range partitions.

Turns are ordered by turn number, null first; equal numbers by role, then by the SHA-256 of role and
text; repeated rows are turns like any other. Null role or text counts as empty. Rows without a
conversation id belong to no conversation and are left out. A base that is not there gives no head.
An empty table gives no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import bound_batches
from shelfwise.session import materialize

#: moduli of the lanes, primes just below 2**31: products of two residues fit 64 bits
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
LANES = range(len(PRIMES))
#: rows whose powers are taken from one table
STEP = 4096
ATTEMPTS = 4
#: bytes of an id list hashed at a time
CHUNK_BYTES = 1 << 20


def multipliers(attempt: int) -> list[int]:
    digest = hashlib.sha256(b"multipliers %d" % attempt).digest()
    return [int.from_bytes(digest[8 * k : 8 * k + 8], "big") % (p - 1000) + 500 for k, p in enumerate(PRIMES)]


def _stored_turns(df: DataFrame, conv: str, turn: str, role: str, text: str, bases: list[int]) -> DataFrame:
    """Turns in order, each with the products before it (``b0``..) and up to it (``e0``..) in its partition."""
    role_of, text_of = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    named = F.concat(F.octet_length(role_of).cast("string"), F.lit(":"), role_of, text_of)
    rows = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        role_of.alias("role"),
        F.unhex(F.sha2(named.cast("binary"), 256)).alias("digest"),
        F.char_length(text_of).cast("bigint").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),  # parts equal rows, whose order is of no matter
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv", "digest", "n_chars", F.spark_partition_id().alias("part"))
    bound_batches(df.sparkSession)
    lanes = [f"{side}{k}" for side in "be" for k in LANES]
    schema = "conv bigint, part int, idx bigint, n_chars bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, "
    schema += ", ".join(f"{c} bigint" for c in lanes)
    names = [c.split()[0] for c in schema.split(", ")]
    tables = []
    for base, p in zip(bases, PRIMES):
        powers, x = np.empty(STEP, np.uint64), 1
        for i in range(STEP):
            powers[i], x = x, x * base % p
        tables.append(powers)

    def products(batches):
        done, sums = 0, [0] * len(PRIMES)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                n = part.num_rows
                words = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(n, 4)
                before, upto = [], []
                for k, p in enumerate(PRIMES):
                    power = tables[k][:n] * np.uint64(pow(bases[k], done, p)) % np.uint64(p)
                    run = np.cumsum(words[:, k] % np.uint64(p) * power % np.uint64(p))
                    run = (run + np.uint64(sums[k])) % np.uint64(p)
                    before.append(np.concatenate((np.array([sums[k]], np.uint64), run[:-1])))
                    upto.append(run)
                    sums[k] = int(run[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(3),
                        pa.array(np.arange(done, done + n, dtype=np.int64)),
                        part.column(2),
                        *[pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(4)],
                        *[pa.array(x.astype(np.int64)) for x in before + upto],
                    ],
                    names,
                )
                done += n

    return materialize(placed.mapInArrow(products, schema), "turns")


def _combined(stored: DataFrame, bases: list[int]) -> DataFrame:
    """The stored turns with products over the whole table, and ``rank``, the place in it."""
    last = stored.groupBy("part").agg(
        F.max("idx").alias("idx"), *[F.max_by(f"e{k}", "idx").alias(f"e{k}") for k in LANES]
    )
    rows, before, sums = [], 0, [0] * len(PRIMES)
    for r in last.orderBy("part").collect():  # one row per partition
        factor = [pow(bases[k], before, p) for k, p in enumerate(PRIMES)]
        rows.append((r["part"], before, *sums, *factor))
        sums = [(sums[k] + factor[k] * r[f"e{k}"]) % p for k, p in enumerate(PRIMES)]
        before += r["idx"] + 1
    lanes = [f"{side}{k} bigint" for side in ("sum", "factor") for k in LANES]
    parts = stored.sparkSession.createDataFrame(rows, "part int, before bigint, " + ", ".join(lanes))
    whole = {
        f"{side}{k}": (F.col(f"factor{k}") * F.col(f"{side}{k}") + F.col(f"sum{k}")) % p
        for side in "be"
        for k, p in enumerate(PRIMES)
    }
    return (
        stored.join(F.broadcast(parts), "part")
        .withColumns({"rank": F.col("before") + F.col("idx"), **whole})
        .select("conv", "rank", "n_chars", *[f"s{k}" for k in range(4)], *[f"{s}{k}" for s in "be" for k in LANES])
    )


def _with_powers(convs: DataFrame, bases: list[int], exponents: dict[str, Column]) -> DataFrame:
    """Columns ``<name>0``.. with the multipliers to the power of the given (also negative) exponents."""
    given = convs.withColumns({f"exp_{n}": e for n, e in exponents.items()})
    kept, wanted = convs.columns, list(exponents)
    fields = [f"{n}{k}" for n in wanted for k in LANES]
    schema = T.StructType([*convs.schema.fields, *[T.StructField(f, T.LongType()) for f in fields]])

    def run(batches):
        for batch in batches:
            columns = batch.columns[: len(kept)]
            for name in wanted:
                of = batch.column(batch.schema.get_field_index(f"exp_{name}")).to_pylist()
                columns += [pa.array([pow(bases[k], x, p) for x in of], pa.int64()) for k, p in enumerate(PRIMES)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *fields])

    return given.mapInArrow(run, schema)


def _stretch(upto: str, before: str, factor: str, k: int) -> Column:
    """Lane ``k`` of the product of stored turns between two points, times a factor."""
    p = PRIMES[k]
    return (F.col(f"{upto}{k}") - F.col(f"{before}{k}") + p) % p * F.col(f"{factor}{k}") % p


def _packed(lanes: list[Column], name: str) -> list[Column]:
    return [(F.shiftleft(lanes[i], 31) + lanes[i + 1]).alias(f"{name}{i // 2}") for i in (0, 2)]


def _prefixes(turns: DataFrame, base: Column, head: Column, bases: list[int]) -> tuple[DataFrame, DataFrame]:
    """(prefix rows, ends of conversations), both by fingerprint.

    A stretch of a conversation's own turns has one row per turn. Heads are shared by all conversations
    with one base: one row per turn of the base, with the number of its users and the smallest of them.
    """
    sizes = turns.groupBy("conv").agg(F.min("rank").alias("start"), F.count("*").alias("size"))
    convs = sizes.withColumns({"base": base, "head": F.greatest(head.cast("bigint"), F.lit(0))})
    of_base = sizes.select(F.col("conv").alias("base"), F.col("start").alias("base_start"), F.col("size").alias("base_size"))
    convs = convs.join(of_base, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_size", F.lit(0))))
    convs = _with_powers(
        convs,
        bases,
        {
            "own": F.col("taken") - F.col("start") - F.col("head"),
            "shared": -F.coalesce("base_start", F.lit(0)),
        },
    )
    convs = materialize(convs, "conversations")

    # heads: products of base turns; a base's users by how many turns they take
    users = convs.filter("taken > 0").groupBy("base", "taken", "base_start", *[f"shared{k}" for k in LANES]).agg(
        F.count("*").alias("n"), F.min("conv").alias("least")
    )
    most = users.groupBy("base").agg(F.max("taken").alias("most"), F.max("base_start").alias("base_start"))
    first = turns.withColumnRenamed("conv", "base").join(most, "base").withColumn("depth", F.col("rank") - F.col("base_start") + 1)
    first = first.filter("depth <= most").drop("most", "base_start")
    start = first.filter("depth = 1").select("base", *[F.col(f"b{k}").alias(f"z{k}") for k in LANES])
    by_depth = users.select("base", F.explode(F.sequence(F.lit(1), "taken")).alias("depth"), "n", "least", *[f"shared{k}" for k in LANES])
    by_depth = by_depth.groupBy("base", "depth", *[f"shared{k}" for k in LANES]).agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    heads = first.join(start, "base").join(by_depth, ["base", "depth"])
    heads = heads.withColumns(
        {f"f{k}": _stretch("e", "z", "shared", k) for k in LANES} | {f"g{k}": _stretch("b", "z", "shared", k) for k in LANES}
    )
    heads = materialize(heads, "heads")

    # own stretches: the product of the head taken, times that of the turns after the cut
    whole_heads = heads.select("base", F.col("depth").alias("taken"), *[F.col(f"f{k}").alias(f"h{k}") for k in LANES])
    cut = convs.join(whole_heads, ["base", "taken"], "left").select(
        "conv", "start", "size", "head", "taken", *[f"own{k}" for k in LANES],
        *[F.coalesce(f"h{k}", F.lit(0)).alias(f"h{k}") for k in LANES],
    )
    own = turns.join(cut.filter("head < size"), "conv").filter("rank >= start + head")
    at_cut = own.filter(F.col("rank") == F.col("start") + F.col("head")).select("conv", *[F.col(f"b{k}").alias(f"z{k}") for k in LANES])
    own = own.join(at_cut, "conv").withColumns(
        {f"f{k}": (_stretch("e", "z", "own", k) + F.col(f"h{k}")) % p for k, p in enumerate(PRIMES)}
        | {f"g{k}": (_stretch("b", "z", "own", k) + F.col(f"h{k}")) % p for k, p in enumerate(PRIMES)}
        | {"depth": F.col("rank") - F.col("start") - F.col("head") + F.col("taken") + 1, "n": F.lit(1).cast("bigint"), "least": F.col("conv")}
    )
    shown = [
        "depth", "n", "least", "rank", "n_chars", *[f"s{k}" for k in range(4)],
        *_packed([F.col(f"f{k}") for k in LANES], "fp"), *_packed([F.col(f"g{k}") for k in LANES], "up"),
    ]
    last = F.col("rank") == F.col("start") + F.col("size") - 1
    own = materialize(own.select("conv", last.alias("last"), *shown), "prefixes")
    lanes = [F.col(f"h{k}") for k in LANES]
    ends = own.filter("last").select("depth", "fp0", "fp1", "conv").unionByName(
        cut.filter("head >= size").select(F.col("taken").alias("depth"), *_packed(lanes, "fp"), "conv")
    )
    return own.drop("conv", "last").unionByName(heads.select(*shown)), ends


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, fp0, fp1, ends_sha256): SHA-256 of the ascending, comma-joined ids of each group.

    Tasks of a range partition write their ids into texts of bounded length first, so what one task
    hashes for a very large group are a few long texts in order, never a gathered list.
    """
    keys = ["depth", "fp0", "fp1"]
    placed = ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").select(*keys, "conv")

    def pack(batches):
        key, first, ids, size = None, None, [], 0

        def packed():
            return pa.RecordBatch.from_pylist([dict(zip(names, (*key, first, ",".join(ids))))], schema=packed_schema)

        for batch in batches:
            for *now, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if now != key or size > CHUNK_BYTES:
                    if key is not None:
                        yield packed()
                    key, first, ids, size = now, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if key is not None:
            yield packed()

    names = [*keys, "first", "ids"]
    packed_schema = pa.schema([(n, pa.int64()) for n in names[:-1]] + [("ids", pa.string())])
    chunks = placed.mapInArrow(pack, "depth bigint, fp0 bigint, fp1 bigint, first bigint, ids string")
    dealt = chunks.repartition(*keys).sortWithinPartitions(*keys, "first")
    hashed_names = [*keys, "ends_sha256"]

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for *now, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if now != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(hashed_names, r)) for r in out], schema=hashed_schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(hashed_names, (*key, sha.hexdigest())))], schema=hashed_schema)

    hashed_schema = pa.schema([(n, pa.int64()) for n in keys] + [("ends_sha256", pa.string())])
    return dealt.mapInArrow(digest, "depth bigint, fp0 bigint, fp1 bigint, ends_sha256 string")


def _totals_of_paths(paths: DataFrame) -> DataFrame:
    """(path, saved, leaves) with all paths below added; ``paths``: path, up, saved, leaves.

    After round ``k`` a path holds the sums of all paths fewer than 2**k steps below it; each then hands
    what it holds to the path 2**k steps above.
    """
    now = materialize(paths, "paths")
    while not now.filter("up IS NOT NULL").isEmpty():
        given = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(
            F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves")
        )
        above = now.select(F.col("path").alias("up"), F.col("up").alias("above"))
        now = materialize(
            now.join(given, "path", "left").join(above, "up", "left").select(
                "path",
                F.col("above").alias("up"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            ),
            "paths",
        )
    return now.drop("up")


def _running(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """``df`` with ``values`` summed over the key's rows from this one to the greatest ``order``, in chunks.

    A chunk is what one range partition holds of a key; sums of later chunks are at most one row per
    partition, as only a partition's last key goes on after it.
    """
    placed = materialize(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "ranged")
    chunks = Window.partitionBy(key).orderBy(F.desc("_part"))
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    later = (
        placed.groupBy(key, "_part")
        .agg(*[F.sum(v).alias(v) for v in values])
        .withColumns({f"_later_{v}": F.sum(v).over(earlier) for v in values} | {"_nth": F.row_number().over(chunks)})
        .filter("_nth > 1")
        .select(F.col(key).alias("_key"), F.col("_part").alias("_of"), *[f"_later_{v}" for v in values])
    )
    inside = Window.partitionBy(key, "_part").orderBy(F.desc(order))
    joined = placed.join(F.broadcast(later), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")), "left")
    return joined.withColumns({v: F.sum(v).over(inside) + F.coalesce(f"_later_{v}", F.lit(0)) for v in values}).drop(
        "_part", "_key", "_of", *[f"_later_{v}" for v in values]
    )


def _nodes(df: DataFrame, base: Column, head: Column, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Verified nodes but the root (depth, fp, up, least, n, n_chars, rank), and the ends."""
    for attempt in range(ATTEMPTS):
        bases = multipliers(attempt)
        turns = _combined(_stored_turns(df, *columns, bases), bases)
        prefixes, ends = _prefixes(turns, base, head, bases)
        same = [*[f"s{k}" for k in range(4)], "n_chars", "up0", "up1"]
        differ = F.lit(False)
        for c in same:
            differ = differ | (F.min(c) != F.max(c))
        nodes = materialize(
            prefixes.groupBy("depth", "fp0", "fp1").agg(
                F.sum("n").alias("n"), F.min("least").alias("least"), F.min("rank").alias("turn_ref"),
                F.max("n_chars").alias("n_chars"), F.max("up0").alias("up0"), F.max("up1").alias("up1"),
                differ.alias("differ"),
            ),
            "nodes",
        )
        if nodes.filter("differ").isEmpty():
            return nodes.drop("differ"), ends
    raise RuntimeError(f"unequal prefixes met under one fingerprint, {ATTEMPTS} times")


def prefix_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    base: Column | None = None,
    head: Column | None = None,
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty one included.

    ``base`` and ``head``: expressions over ``conv``, the id, that say whose first turns a conversation
    begins with, and how many; by default conversations stand as they are.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (of the subtree, a token is a code point), ends_sha256, and turn_ref, the place of the
    first equal last turn among the stored turns (null for the root).
    """
    base = F.col("conv") if base is None else base
    head = F.lit(0) if head is None else head
    nodes, ends = _nodes(df, base, head, (conv_col, turn_col, role_col, text_col))
    ends = materialize(ends, "ends")
    totals = ends.agg(F.count("*").alias("n"), F.min("conv").alias("least"))
    null = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    root = totals.filter("n > 0").select(
        zero.alias("depth"), zero.alias("fp0"), zero.alias("fp1"), "n", "least", null.alias("turn_ref"),
        zero.alias("n_chars"), null.alias("up0"), null.alias("up1"),
    )
    nodes = nodes.unionByName(root)
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("fp0").alias("up0"), F.col("fp1").alias("up1"), F.col("least").alias("parent")
    )
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up0").alias("fp0"), F.col("up1").alias("fp1")).agg(
        F.count("*").alias("n_children")
    )
    key = ["depth", "fp0", "fp1"]
    linked = (
        nodes.join(above, ["depth", "up0", "up1"], "left")
        .join(children, key, "left")
        .join(_end_digests(ends), key, "left")
        .select(
            F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.coalesce("n_children", zero).alias("n_children"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            "turn_ref",
            ((F.col("n") - 1) * F.col("n_chars")).alias("saved"),
        )
        .withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"))
    )
    linked = materialize(linked, "linked")
    outside = F.col("parent_conv_id") != F.col("conv_id")
    paths = linked.groupBy(F.col("conv_id").alias("path")).agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"),
        F.max(F.when(outside, F.col("parent_conv_id"))).alias("up"), F.min("depth").alias("top"),
    )
    paths = materialize(paths, "path_sums")
    below = _totals_of_paths(paths.select("path", "up", "saved", "leaves"))
    hung = (
        paths.filter("up IS NOT NULL").select("path", "up", "top").join(below, "path")
        .groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth"))
        .agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    )
    own = linked.join(hung, ["conv_id", "depth"], "left").withColumns(
        {c: F.col(c) + F.coalesce(f"hung_{c}", zero) for c in ("saved", "leaves")}
    )
    own = own.drop("hung_saved", "hung_leaves")
    return _running(own, "conv_id", "depth", ["saved", "leaves"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256", "turn_ref",
    )
