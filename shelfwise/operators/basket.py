"""Basket assembly and the comparison of baskets between chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.numbers import round_half_up
from shelfwise.functions.text import alternative_stem, js_trim
from shelfwise.operators.search import best_per_chain, chain_offers
from shelfwise.session import materialize
from shelfwise.sources.snapshot import Catalog

_WANT = ["query", "city", "county"]


def assemble_baskets(events: DataFrame) -> DataFrame:
    """Merge added items case-insensitively: quantities add up, the first spelling stays.

    ``events``: basket_id, seq, query, qty and optionally city, county.
    """
    place = [c for c in ("city", "county") if c in events.columns]
    first = F.min(F.struct("seq", "query", *place)).alias("first")
    return (
        events.groupBy("basket_id", F.lower("query").alias("query_key"))
        .agg(F.sum("qty").alias("qty"), first)
        .select("basket_id", "first.seq", "first.query", "qty", *[f"first.{c}" for c in place])
    )


def valid_lines(lines: DataFrame, max_items: int | None = None) -> DataFrame:
    """Lines with a non-blank query, numbered per basket.

    Baskets of any size are answered. With ``max_items`` a larger basket is refused
    whole; only its first ``max_items + 1`` lines travel, enough to see that.
    """
    basket = Window.partitionBy("basket_id")
    ordered = basket.orderBy("seq", "query")
    numbered = (
        lines.filter(js_trim(F.col("query")) != "")
        .withColumn("qty", F.when(F.col("qty") > 0, F.col("qty")).otherwise(F.lit(1.0)))
        .withColumn("item_no", F.row_number().over(ordered))
    )
    if max_items is None:
        return numbered
    return (
        numbered.filter(F.col("item_no") <= max_items + 1)
        .withColumn("n_items", F.count("*").over(basket))
        .filter(F.col("n_items") <= max_items)
        .drop("n_items")
    )


def _asked(lines: DataFrame) -> DataFrame:
    """Distinct (query, place) pairs, written once: every later step starts from them."""
    pairs = materialize(lines.select(*_WANT).distinct(), "asked")
    return pairs.select(F.struct(*_WANT).alias("query_id"), F.col("query").alias("q"), "city", "county")


def _stored(lines: DataFrame) -> DataFrame:
    """What sums over lines need of them, written once: they are made from the events a single time."""
    return materialize(lines.select("basket_id", "qty", *_WANT), "lines")


def _every_chain(cat: Catalog) -> Column:
    """All chains as one array, by name: as many as a basket's answer lists."""
    entry = F.struct("name", F.col("id").alias("supermarket_id"), "slug")
    return cat.supermarkets.agg(F.sort_array(F.collect_list(entry)).alias("chains")).scalar()


def _places(cat: Catalog) -> DataFrame:
    """(supermarket_id, pos): the index of every chain in :func:`_every_chain`."""
    entry = F.struct("name", F.col("id").alias("supermarket_id"), "slug")
    every = cat.supermarkets.agg(F.sort_array(F.collect_list(entry)).alias("chains"))
    return every.select(F.posexplode("chains").alias("pos", "c")).select("c.supermarket_id", "pos")


def _others(pos: Column, every: Column) -> Column:
    """Indexes into ``every`` that are not in ``pos``, ascending."""
    return F.array_except(F.sequence(F.lit(0), F.size(every) - 1), pos)


def _without(every: Column, found: Column) -> Column:
    """The chains whose ids are not in ``found``."""
    return F.filter(every, lambda c: ~F.array_contains(found, c["supermarket_id"]))


def _lists(rows: DataFrame, *columns: str) -> DataFrame:
    """(query_id, chains): one array per (query, place), of the chains that have a row only."""
    return rows.groupBy("query_id").agg(F.collect_list(F.struct(*columns)).alias("chains"))


def _join_lines(lines: DataFrame, answers: DataFrame, how: str = "inner") -> DataFrame:
    keyed = answers.select(*[F.col(f"query_id.{c}").alias(f"a_{c}") for c in _WANT], "chains")
    on = [F.col("query") == F.col("a_query")]
    on += [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in ("city", "county")]
    return lines.join(keyed, on, how).drop("a_query", "a_city", "a_county")


def _per_basket(lines: DataFrame, lists: DataFrame, empty: str, **sums: Column) -> DataFrame:
    """(basket_id, item_count, found): sums over a basket's lines for every chain in their lists.

    ``found`` is an array of (pos, sums), at most as long as there are chains; chains in no list have no
    row. Lines move once, with their lists, and are unfolded and added up where their basket is, one at a time;
    a popular query is not gathered. One entry without a chain counts the lines.
    """
    counting = F.array(F.lit(None).cast(empty))
    entries = F.concat(counting, F.coalesce("chains", F.array().cast(f"array<{empty}>")))
    joined = _join_lines(lines, lists, "left").select("basket_id", "qty", "chains").repartition("basket_id")
    rows = joined.select("basket_id", "qty", F.explode(entries).alias("c"))
    per_chain = rows.groupBy("basket_id", F.col("c.pos").alias("pos")).agg(
        F.count("*").alias("n"), *[e.alias(k) for k, e in sums.items()]
    )
    one = F.struct("pos", *sums)
    return per_chain.groupBy("basket_id").agg(
        F.max(F.when(F.col("pos").isNull(), F.col("n"))).alias("item_count"),
        F.collect_list(F.when(F.col("pos").isNotNull(), one)).alias("found"),
        F.collect_list("pos").alias("pos"),
    )


def compare_baskets(
    cat: Catalog, lines: DataFrame, pick: str = "best_rank", max_items: int | None = None
) -> DataFrame:
    """Total, coverage and rank of every chain for every basket.

    The distinct (query, place) pairs are answered once, with the chains that have something only;
    sums are made for those, and what a chain without anything gets is derived as the last ranks.
    """
    lines = _stored(valid_lines(lines, max_items))
    best = best_per_chain(cat, _asked(lines), strict=True, pick=pick).join(F.broadcast(_places(cat)), "supermarket_id")
    found = materialize(_lists(best, "pos", "price"), "answers")
    sums = _per_basket(
        lines,
        found,
        "struct<pos:int,price:double>",
        total=round_half_up(F.coalesce(F.sum(F.col("c.price") * F.col("qty")), F.lit(0.0)), 2),
        found_count=F.count("c.price"),
    )
    # chains stand in order of their names, which decide ties
    ordered = F.sort_array(
        F.transform(
            "found",
            lambda x: F.struct((-x["found_count"]).alias("less"), x["total"].alias("total"), x["pos"].alias("pos")),
        )
    )
    ranked = sums.withColumn("every", _every_chain(cat)).select(
        "basket_id", "item_count", "every", ordered.alias("ranked"), _others(F.col("pos"), F.col("every")).alias("missing")
    )

    def row(pos: Column, total: Column, count: Column, rank: Column) -> Column:
        return F.struct(pos.alias("pos"), total.alias("total"), count.alias("found_count"), rank.cast("int").alias("chain_rank"))

    rows = F.concat(
        F.transform("ranked", lambda x, i: row(x["pos"], x["total"], -x["less"], i + 1)),
        F.transform("missing", lambda p, i: row(p, F.lit(0.0), F.lit(0).cast("bigint"), F.size("ranked") + i + 1)),
    )
    listed = ranked.select("basket_id", "item_count", "every", F.inline(rows))
    chain = F.get("every", F.col("pos"))
    return listed.select(
        "basket_id", "item_count", chain["supermarket_id"].alias("supermarket_id"), "total", "found_count",
        chain["slug"].alias("slug"), chain["name"].alias("name"), "chain_rank",
        (F.col("item_count") - F.col("found_count")).alias("missing_count"),
    )


def top_chains(comparison: DataFrame, n: int = 3) -> DataFrame:
    """Best ``n`` chains per basket among those with anything found.

    Coverage is the first sort key, so these are also the first ranks overall.
    """
    return comparison.filter((F.col("found_count") > 0) & (F.col("chain_rank") <= n))


def runners_up(comparison: DataFrame, n: int = 3) -> DataFrame:
    return comparison.filter((F.col("found_count") > 0) & (F.col("chain_rank") > n))


def alternatives(
    cat: Catalog, misses: DataFrame, reference_compat: bool = True, offers: DataFrame | None = None
) -> DataFrame:
    """Loose suggestions for missed (query, city, county, supermarket_id) rows.

    The longest word of the query, cut to a stem, is searched as a word prefix
    in the chain that missed it. ``offers``: stored ``chain_offers`` of the places.
    """
    staged = misses.withColumn("stem", alternative_stem(F.col("query"))).filter(
        F.col("stem").isNotNull()
    )
    asked = staged.select("stem", "city", "county").distinct()
    best = best_per_chain(
        cat,
        asked.select(F.struct("*").alias("query_id"), F.col("stem").alias("q"), "city", "county"),
        strict=False,
        prefix=True,
        reference_compat=reference_compat,
        offers=offers,
    ).select(
        *[F.col(f"query_id.{c}").alias(f"b_{c}") for c in ("stem", "city", "county")],
        F.col("supermarket_id").alias("b_supermarket_id"),
        F.col("match_rank").alias("alt_rank"),
        F.col("price").alias("alt_price"),
        F.col("product_id").alias("alt_product_id"),
        F.col("store_id").alias("alt_store_id"),
    )
    on = [F.col("stem") == F.col("b_stem"), F.col("supermarket_id") == F.col("b_supermarket_id")]
    on += [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in ("city", "county")]
    return staged.join(best, on).drop("b_stem", "b_city", "b_county", "b_supermarket_id")


def answer_items(cat: Catalog, lines: DataFrame, pick: str = "best_rank") -> DataFrame:
    """Per distinct (query, place, chain): the product found, else an alternative.

    Columns: query, city, county, supermarket_id, product_id, store_id, price,
    alt_product_id, alt_store_id, alt_price.
    """
    found, missed, offers = _answered(cat, lines, pick)
    keys = [*_WANT, "supermarket_id"]
    alts = alternatives(cat, missed, offers=offers)
    a = alts.select(
        *[F.col(c).alias(f"m_{c}") for c in keys], "alt_product_id", "alt_store_id", "alt_price"
    )
    on = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in keys]
    others = missed.join(a, on, "left").drop(*[f"m_{c}" for c in keys])
    return found.select("query_id.*", *[c for c in found.columns if c != "query_id"]).unionByName(
        others, allowMissingColumns=True
    )


def _answered(cat: Catalog, lines: DataFrame, pick: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, missed, offers): products found, the complement, and the offers both kinds of search read."""
    asked = _asked(lines)
    offers = materialize(chain_offers(cat, asked), "offers")
    found = materialize(
        best_per_chain(cat, asked, strict=True, pick=pick, offers=offers).select(
            "query_id", "supermarket_id", "product_id", "store_id", "price"
        ),
        "answers",
    )
    return found, _missed(cat, asked, found), offers


def missed_alternatives(cat: Catalog, lines: DataFrame, pick: str = "best_rank") -> DataFrame:
    """:func:`alternatives` of every distinct (query, place) in the chains without a product."""
    _, missed, offers = _answered(cat, lines, pick)
    return alternatives(cat, missed, offers=offers)


def _missed(cat: Catalog, asked: DataFrame, found: DataFrame) -> DataFrame:
    """(query, city, county, supermarket_id): the complement of what was found, chain by chain."""
    has = found.groupBy("query_id").agg(F.collect_list("supermarket_id").alias("has"))
    none = F.array().cast("array<bigint>")
    left = asked.select("query_id").join(has, "query_id", "left").withColumn("every", _every_chain(cat))
    gone = _without(F.col("every"), F.coalesce("has", none))
    return left.select("query_id.*", F.explode(gone["supermarket_id"]).alias("supermarket_id"))


def missing_counts(cat: Catalog, lines: DataFrame, pick: str = "best_rank") -> DataFrame:
    """Missing items per basket and chain, and how many of them have an alternative, for all chains.

    As :func:`missing_report` of :func:`compare_items`, without a row per line and chain: only chains
    with a product or an alternative are listed, all others miss the whole basket.
    """
    lines = _stored(valid_lines(lines))
    items = answer_items(cat, lines, pick).withColumns(
        {
            "query_id": F.struct(*_WANT),
            "found": F.when(F.col("product_id").isNotNull(), 1).otherwise(0),
            "other": F.when(F.col("alt_product_id").isNotNull(), 1).otherwise(0),
        }
    )
    items = items.filter("found + other > 0").join(F.broadcast(_places(cat)), "supermarket_id")
    lists = _lists(items, "pos", "found", "other")
    sums = _per_basket(
        lines,
        lists,
        "struct<pos:int,found:int,other:int>",
        found_count=F.sum("c.found"),
        alternative_count=F.sum("c.other"),
    ).withColumn("every", _every_chain(cat))
    zero = F.lit(0).cast("bigint")
    rows = F.concat(
        F.transform(
            "found",
            lambda x: F.struct(
                x["pos"].alias("pos"),
                (F.col("item_count") - x["found_count"]).alias("missing_count"),
                x["alternative_count"].alias("alternative_count"),
            ),
        ),
        F.transform(
            _others(F.col("pos"), F.col("every")),
            lambda p: F.struct(
                p.alias("pos"), F.col("item_count").alias("missing_count"), zero.alias("alternative_count")
            ),
        ),
    )
    return sums.select("basket_id", "every", F.inline(rows)).select(
        "basket_id", F.get("every", F.col("pos"))["supermarket_id"].alias("supermarket_id"),
        "missing_count", "alternative_count",
    )


def compare_items(cat: Catalog, lines: DataFrame, pick: str = "best_rank") -> DataFrame:
    """One row per basket line and chain, with the product found or its alternative."""
    lines = valid_lines(lines)
    items = (
        answer_items(cat, lines, pick)
        .groupBy(F.struct(*_WANT).alias("query_id"))
        .agg(
            F.collect_list(
                F.struct(
                    "supermarket_id", "product_id", "store_id", "price",
                    "alt_product_id", "alt_store_id", "alt_price",
                )
            ).alias("chains")
        )
    )
    return _join_lines(lines, items).select(
        "basket_id", "item_no", "query", "qty", F.inline("chains")
    )


def comparison_items(cat: Catalog, lines: DataFrame, pick: str = "best_rank") -> DataFrame:
    """As :func:`compare_items`, gathered into one ordered ``items`` array per basket and chain.

    An array is as long as its basket.
    """
    rows = compare_items(cat, lines, pick)
    item = F.struct(
        "item_no", "query", "qty", "product_id", "store_id", "price",
        "alt_product_id", "alt_store_id", "alt_price",
    )
    return rows.groupBy("basket_id", "supermarket_id").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )


def missing_report(items: DataFrame) -> DataFrame:
    """Missing items per basket and chain, and how many of them have an alternative.

    Alternatives never count towards the total or the coverage.
    """
    missing = F.col("product_id").isNull()
    return items.groupBy("basket_id", "supermarket_id").agg(
        F.count_if(missing).alias("missing_count"),
        F.count_if(missing & F.col("alt_product_id").isNotNull()).alias("alternative_count"),
    )
