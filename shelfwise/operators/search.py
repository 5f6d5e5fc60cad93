"""Ranked product search, many queries per job.

A query matches a product when all its words are in the product's search name.
Names are looked up through the catalogue's stored index by equi-joins: each query
probes the postings of its rarest word only (its *anchor*) and the other words are
checked on the surviving pairs, so no query meets a name that lacks its rarest word.

Ranking is (match rank, price), ties broken by product id and store id. The
match rank is the earliest position of a query word in the name, plus 1000 for
products outside the category the query maps to. A single word that maps to a
category also brings in the whole category, after the direct matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.categories import FALLBACK, category_of_normalized
from shelfwise.functions.text import (
    NO_POSITION,
    first_position,
    has_word_prefixes,
    has_words,
    normalize_text,
    tokens_of,
)
from shelfwise.schemas import NATIONAL
from shelfwise.session import broadcast_if_small, materialize
from shelfwise.sources.search_index import SearchIndex
from shelfwise.sources.snapshot import Catalog

#: longest word beginning indexed for prefix search; longer ones are checked after the join
PREFIX_KEY = 6
#: parts in which a word's postings are probed
SALTS = 16
OUTSIDE_CATEGORY = 1000

# what decides which names match a query, and how they rank
SHAPE = ["nq", "prefix", "by_category"]

_OPTIONS = {
    "category": "string",
    "city": "string",
    "county": "string",
    "supermarket": "string",
    "strict": "boolean",
    "prefix": "boolean",
}


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Fill in missing options and add the normalised text and the category arm."""
    have = set(queries.columns)
    cols = [F.col("query_id"), F.col("q")]
    for name, kind in _OPTIONS.items():
        value = F.col(name) if name in have else F.lit(None)
        value = value.cast(kind)
        if kind == "boolean":
            value = F.coalesce(value, F.lit(False))
        else:
            value = F.nullif(value, F.lit(""))
        cols.append(value.alias(name))
    q = queries.select(*cols).withColumn("nq", normalize_text(F.coalesce("q", F.lit(""))))
    one_word = (F.col("nq") != "") & ~F.contains(F.col("nq"), F.lit(" "))
    q = q.withColumn("cat_slug", category_of_normalized(None, F.col("nq")))
    return q.withColumn(
        "by_category", ~F.col("strict") & one_word & (F.col("cat_slug") != FALLBACK)
    )


def _probed(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """Distinct (query shape, name) pairs whose name holds the shape's ``word``.

    A word's postings are probed in :data:`SALTS` parts, so a word that very many names hold is no
    one task's; names are looked up once per pair.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    postings = index.postings.withColumn("salt", F.pmod("name_id", F.lit(SALTS)).cast("int"))
    pairs = asked.select(*SHAPE, "word", salts.alias("salt")).join(postings, ["word", "salt"]).select(*SHAPE, "name_id")
    # several words of a shape's prefix, or several parts of the index, may lead to one name
    return pairs.distinct().join(index.names.distinct() if index.several_parts else index.names, "name_id")


def name_matches(
    index: SearchIndex, shapes: DataFrame, reference_compat: bool = True
) -> DataFrame:
    """Matching (query shape, name, category) triples with their match rank.

    With ``reference_compat`` a one-word prefix query that maps to a category
    keeps only names of that category (or holding the literal text ``% word%``).
    """
    shapes = shapes.select(*SHAPE).filter(F.col("nq") != "").distinct()

    whole = shapes.filter(~F.col("prefix"))
    rarest = (
        whole.select(*SHAPE, F.explode(F.array_distinct(tokens_of(F.col("nq")))).alias("word"))
        .join(index.vocabulary, "word", "left")
        .groupBy(*SHAPE, "word")
        .agg(F.coalesce(F.sum("names_with"), F.lit(0)).alias("n"))
        .groupBy(*SHAPE)
        .agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    )
    whole_hits = _probed(index, rarest).filter(
        has_words(F.col("normalized_name"), tokens_of(F.col("nq")))
    )

    begun = shapes.filter("prefix").withColumn(
        "start",
        F.array_max(
            F.transform(
                tokens_of(F.col("nq")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))
            )
        ).getField("t"),
    ).withColumn("word_key", F.substring("start", 1, PREFIX_KEY))
    keyed_words = index.vocabulary.select(
        "word",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.least(F.lit(PREFIX_KEY), F.length("word"))),
                lambda n: F.substring(F.col("word"), F.lit(1), n),
            )
        ).alias("word_key"),
    )
    starts = begun.join(keyed_words, "word_key").filter(F.startswith("word", "start")).select(*SHAPE, "word")
    prefix_hits = (
        _probed(index, starts.distinct() if index.several_parts else starts)
        .filter(has_word_prefixes(F.col("normalized_name"), tokens_of(F.col("nq"))))
    )
    hits = whole_hits.select(*SHAPE, "normalized_name", "category").unionByName(
        prefix_hits.select(*SHAPE, "normalized_name", "category")
    )
    hits = hits.withColumn("cat_slug", category_of_normalized(None, F.col("nq")))
    in_category = F.coalesce(F.col("category") == F.col("cat_slug"), F.lit(False))
    if reference_compat:
        literal = F.contains(
            F.concat(F.lit(" "), "normalized_name", F.lit(" ")),
            F.concat(F.lit("% "), "nq", F.lit("%")),
        )
        hits = hits.filter(~(F.col("prefix") & F.col("by_category")) | in_category | literal)
    position = first_position(F.col("normalized_name"), tokens_of(F.col("nq")), F.col("prefix"))
    outside = (F.col("cat_slug") != FALLBACK) & ~in_category
    return hits.select(
        *SHAPE,
        "normalized_name",
        "category",
        (F.when(outside, OUTSIDE_CATEGORY).otherwise(0) + position).alias("match_rank"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _priced(cat: Catalog, candidates: DataFrame) -> DataFrame:
    """Candidates with product_id joined to the prices their locality allows.

    National prices always pass; a price whose store is unknown passes only
    without a locality.
    """
    prices = cat.prices.select(F.col("product_id").alias("p_id"), "store_id", "price")
    places = cat.stores.select(
        F.col("id").alias("st_id"), F.col("city").alias("st_city"), F.col("county").alias("st_county")
    )
    joined = candidates.join(prices, F.col("product_id") == F.col("p_id")).join(
        places, F.col("store_id") == F.col("st_id"), "left"
    )
    national = F.col("store_id") == NATIONAL
    for want, have in (("city", "st_city"), ("county", "st_county")):
        joined = joined.filter(
            F.col(want).isNull() | national | (F.col(have) == F.col(want))
        )
    return joined.drop("p_id", "st_id", "st_city", "st_county")


def _products_of(cat: Catalog, key: str) -> DataFrame:
    chains = cat.supermarkets.select(F.col("id").alias("chain"), F.col("slug").alias("chain_slug"))
    rows = cat.products.select(
        F.col("id").alias("product_id"),
        F.col("supermarket_id"),
        F.col("normalized_name").alias("p_name"),
        F.col("category").alias("p_category"),
    )
    if key == "category":
        rows = rows.drop("p_name")
    return rows.join(chains, F.col("supermarket_id") == F.col("chain")).drop("chain")


_ORDER = ["match_rank", "price", "product_id", "store_id"]


def _first_rows(df: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """First ``n`` rows per key in search order; Spark limits each group before the shuffle."""
    if n is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*_ORDER)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def _best_offers(rows: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """The first offer of every product, and the first ``n`` of those per key."""
    best = rows.groupBy(*keys, "product_id").agg(F.min(F.struct("match_rank", "price", "store_id")).alias("r"))
    return _first_rows(best.select(*keys, "product_id", "r.*").select(*keys, *_ORDER), keys, n)


def _name_arm(cat: Catalog, q: DataFrame, cap: int | None, compat: bool, limit: int | None) -> DataFrame:
    matches = name_matches(cat.search_index(), q, compat)
    wanted = (
        q.withColumnRenamed("category", "want_category")
        .drop("cat_slug")
        .join(matches, SHAPE)
        .filter(F.col("want_category").isNull() | (F.col("want_category") == F.col("category")))
    )
    rows = wanted.join(
        _products_of(cat, "name"),
        (F.col("normalized_name") == F.col("p_name")) & _same("category", "p_category"),
    ).filter(F.col("supermarket").isNull() | (F.col("supermarket") == F.col("chain_slug")))
    rows = _priced(cat, rows.select("query_id", "city", "county", "product_id", "match_rank"))
    rows = rows.select("query_id", *_ORDER)
    return _best_offers(rows, ["query_id"], limit) if cap is None else _first_rows(rows, ["query_id"], cap)


_LIST = ["list_category", "supermarket", "city", "county"]


def _category_arm(cat: Catalog, q: DataFrame, cap: int | None, limit: int | None) -> DataFrame:
    """Whole categories in price order: browsing (rank 0) and one-word queries (last rank).

    Each distinct (category, chain, place) list is ranked once and shared by the
    queries that need it. Direct matches in a list rank better through the name
    arm, so a capped list still covers every row the query can return
    (names are taken to be shorter than the last rank, 9999 characters).
    """
    browsing = (F.coalesce("q", F.lit("")) == "") & F.col("category").isNotNull()
    expanded = F.col("by_category") & (
        F.col("category").isNull() | (F.col("category") == F.col("cat_slug"))
    )
    users = q.filter(browsing | expanded).select(
        "query_id",
        F.when(browsing, F.col("category")).otherwise(F.col("cat_slug")).alias("list_category"),
        "supermarket",
        "city",
        "county",
        F.when(browsing, 0).otherwise(NO_POSITION).alias("match_rank"),
    )
    # few lists go to the products, so that a category of very many products is no one task's
    lists = broadcast_if_small(users.select(*_LIST).distinct())
    rows = lists.join(
        _products_of(cat, "category"), F.col("list_category") == F.col("p_category")
    ).filter(F.col("supermarket").isNull() | (F.col("supermarket") == F.col("chain_slug")))
    rows = _priced(cat, rows.select(*_LIST, "product_id")).withColumn("match_rank", F.lit(0))
    rows = rows.select(*_LIST, *_ORDER)
    rows = _best_offers(rows, _LIST, limit) if cap is None else _first_rows(rows, _LIST, cap)
    rows = rows.select(*[F.col(c).alias(f"of_{c}") for c in _LIST], "price", "product_id", "store_id")
    on = [_same(c, f"of_{c}") for c in _LIST]
    return users.join(rows, on).select("query_id", *_ORDER)


def search_hits(
    cat: Catalog,
    queries: DataFrame,
    limit: int | None = None,
    candidate_cap: int | None = None,
    reference_compat: bool = True,
) -> DataFrame:
    """(query_id, hit_no, match_rank, price, product_id, store_id), best offer per product.

    ``limit`` hits per query, all of them by default. With a ``candidate_cap`` only so many
    product-store rows are ranked before products are reduced to their best offer; without, both ways
    of matching reduce them where they meet their prices, and only ``limit`` of each move on.
    """
    q = prepare_queries(queries)
    offers = _name_arm(cat, q, candidate_cap, reference_compat, limit).unionByName(
        _category_arm(cat, q, candidate_cap, limit)
    )
    if candidate_cap is not None:
        offers = (
            offers.groupBy("query_id", "product_id", "store_id")
            .agg(F.min(F.struct("match_rank", "price")).alias("r"))
            .select("query_id", "product_id", "store_id", "r.match_rank", "r.price")
        )
        offers = _first_rows(offers, ["query_id"], candidate_cap)
    best = _best_offers(offers, ["query_id"], None)
    w = Window.partitionBy("query_id").orderBy(*_ORDER)
    return (
        best.withColumn("hit_no", F.row_number().over(w))
        .filter(F.lit(True) if limit is None else F.col("hit_no") <= limit)
        .select("query_id", "hit_no", *_ORDER)
    )


def with_product_details(cat: Catalog, hits: DataFrame) -> DataFrame:
    """Add the fields a hit shows to rows with product_id and store_id."""
    products = cat.products.select(
        F.col("id").alias("product_id"),
        "supermarket_id",
        "name",
        "brand",
        "category",
        "unit_size",
        "image_url",
        "url",
    )
    chains = cat.supermarkets.select(
        F.col("id").alias("supermarket_id"),
        F.col("slug").alias("supermarket_slug"),
        F.col("name").alias("supermarket_name"),
    )
    prices = cat.prices.select(
        "product_id", "store_id", "old_price", "price_per_unit", "per_unit", "updated_at"
    )
    places = cat.stores.select(F.col("id").alias("store_id"), "city")
    hits = hits.drop(*(set(hits.columns) & {"supermarket_id"}))
    return (
        hits.join(products, "product_id")
        .join(chains, "supermarket_id")
        .join(prices, ["product_id", "store_id"])
        .join(places, "store_id", "left")
    )


def search(cat: Catalog, queries: DataFrame, **options) -> DataFrame:
    """Product hits per query, all display fields included."""
    return with_product_details(cat, search_hits(cat, queries, **options))


_PLACE = ["is_national", "in_city", "in_county"]


def _place(is_national: Column, city: Column, county: Column) -> Column:
    return F.struct(
        is_national.alias("is_national"), city.alias("in_city"), county.alias("in_county")
    )


def chain_offers(cat: Catalog, queries: DataFrame) -> DataFrame:
    """The first offer of every (name, chain, place), for the places of ``queries`` (city, county).

    Whatever the queries' number and kind, so searches over the same places can share it.
    """
    null = F.lit(None).cast("string")
    local = F.lit(False)
    places = (
        queries.select(local.alias("is_national"), F.col("city").alias("in_city"), F.col("county").alias("in_county"))
        .unionByName(
            cat.spark.range(1).select(
                F.lit(True).alias("is_national"), null.alias("in_city"), null.alias("in_county")
            )
        )
        .distinct()
    )
    products = cat.products.select(
        F.col("id").alias("product_id"), "supermarket_id", "normalized_name", "category"
    )
    prices = cat.prices.select("product_id", "store_id", "price")
    stores = cat.stores.select(F.col("id").alias("store_id"), "city", "county")
    city, county = F.col("city"), F.col("county")
    open_to = F.when(
        F.col("store_id") == NATIONAL, F.array(_place(F.lit(True), null, null))
    ).otherwise(
        F.array_compact(
            F.array(
                _place(local, null, null),
                F.when(county.isNotNull(), _place(local, null, county)),
                F.when(city.isNotNull(), _place(local, city, null)),
                F.when(city.isNotNull() & county.isNotNull(), _place(local, city, county)),
            )
        )
    )
    offers = (
        products.join(prices, "product_id")
        .join(stores, "store_id", "left")
        .select(
            "normalized_name", "category", "supermarket_id", "product_id", "store_id", "price",
            F.explode(open_to).alias("place"),
        )
        .select("*", "place.*")
        .drop("place")
    )
    return (
        _semi_null_safe(offers, places, _PLACE)
        .groupBy("normalized_name", "category", "supermarket_id", *_PLACE)
        .agg(F.min(F.struct("price", "product_id", "store_id")).alias("offer"))
    )


def best_per_chain(
    cat: Catalog,
    queries: DataFrame,
    strict: bool,
    prefix: bool = False,
    reference_compat: bool = True,
    pick: str = "best_rank",
    offers: DataFrame | None = None,
) -> DataFrame:
    """First hit of every query in every chain: (query_id, supermarket_id, best).

    ``queries`` holds distinct (query_id, q, city, county) rows. Only the first
    offer of a (name, chain, place) can ever win, so offers are reduced to those
    once, whatever the number of queries, and each query shape is then reduced
    per chain and place before localities are looked up. Chains without a hit
    have no row. ``pick='cheapest'`` orders by price before rank. ``offers``: stored
    :func:`chain_offers` of these places, or of more.
    """
    q = prepare_queries(
        queries.select("query_id", "q", "city", "county").withColumns(
            {"strict": F.lit(strict), "prefix": F.lit(prefix)}
        )
    )
    q = materialize(q, "queries")
    null = F.lit(None).cast("string")
    local, city, county = F.lit(False), F.col("city"), F.col("county")
    reduced = chain_offers(cat, q) if offers is None else offers
    if offers is None and not strict:
        reduced = materialize(reduced, "offers")  # read by name and by category

    def ranked(rank: Column) -> Column:
        order = [rank.alias("match_rank"), F.col("offer.price").alias("price")]
        if pick == "cheapest":
            order.reverse()
        return F.struct(
            *order, F.col("offer.product_id").alias("product_id"),
            F.col("offer.store_id").alias("store_id"),
        ).alias("best")

    matches = name_matches(cat.search_index(), q, reference_compat)
    m = matches.withColumnsRenamed({"normalized_name": "m_name", "category": "m_category"})
    by_shape = m.join(
        reduced,
        (F.col("m_name") == F.col("normalized_name")) & _same("m_category", "category"),
    ).select(*SHAPE, "supermarket_id", *_PLACE, ranked(F.col("match_rank")))
    if not strict:
        whole = (
            reduced.groupBy("category", "supermarket_id", *_PLACE)
            .agg(F.min("offer").alias("offer"))
        )
        shapes = q.filter("by_category").select(*SHAPE, "cat_slug").distinct()
        by_shape = by_shape.unionByName(
            shapes.join(whole, F.col("cat_slug") == F.col("category")).select(
                *SHAPE, "supermarket_id", *_PLACE, ranked(F.lit(NO_POSITION))
            )
        )
    by_shape = by_shape.groupBy(*SHAPE, "supermarket_id", *_PLACE).agg(F.min("best").alias("best"))

    asked = q.select(
        "query_id",
        *SHAPE,
        F.explode(
            F.array(_place(F.lit(True), null, null), _place(local, city, county))
        ).alias("place"),
    ).select("query_id", *SHAPE, *[F.col(f"place.{c}").alias(f"q_{c}") for c in _PLACE])
    on = [F.col(f"a.{c}") == F.col(f"s.{c}") for c in SHAPE]
    on += [F.col(f"a.q_{c}").eqNullSafe(F.col(f"s.{c}")) for c in _PLACE]
    return (
        asked.alias("a")
        .join(by_shape.alias("s"), on)
        .groupBy("query_id", "supermarket_id")
        .agg(F.min("best").alias("best"))
        .select("query_id", "supermarket_id", *[F.col(f"best.{c}").alias(c) for c in _ORDER])
    )


def _semi_null_safe(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    k = keys.select(*[F.col(c).alias(f"k_{c}") for c in columns])
    return df.join(k, [_same(c, f"k_{c}") for c in columns], "left_semi")
