"""The registered queries once more, as plain SQL for another engine.

Written naively (text search by scanning, one row at a time logic as windows),
so that they do not share the plans they check.
"""

from __future__ import annotations

from shelfwise.functions.categories import CATEGORY_RULES, FALLBACK
from shelfwise.functions.geo import CITY_COUNTY, POSTAL_PREFIX_COUNTY
from shelfwise.functions.text import JS_SPACE, NO_POSITION, fold_table
from shelfwise.functions.units import MULTIPACK, PIECE, SINGLE, UNIT_WORDS
from shelfwise.plans.testbed import CITIES, FEED_EPOCH, GROCERY_TERMS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ",".join(lit(v) for v in values) + "]"


def pick(values: list[str], key: str) -> str:
    return f"({sql_list(values)})[CAST(({key}) % {len(values)} AS INTEGER) + 1]"


def norm(x: str) -> str:
    src, dst = fold_table()
    return (
        f"trim(regexp_replace(lower(translate({x}, {lit(src)}, {lit(dst)})), "
        "'[^a-z0-9%,./+-]+', ' ', 'g'))"
    )


def rule_case(n: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({n}, {lit(p)}) THEN {lit(s)}" for p, s in CATEGORY_RULES)
    return f"CASE {whens} END"


def category_of(n: str) -> str:
    return f"coalesce({rule_case(n)}, {lit(FALLBACK)})"


def lookup(table: dict[str, str], key: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {key} {whens} END"


def round2(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def round3(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.5) / 1000)"


def postal_code(key: str) -> str:
    return f"lpad(CAST(({key} * 7919) % 930000 AS VARCHAR), 6, '0')"


def county_of(code: str) -> str:
    return lookup(POSTAL_PREFIX_COUNTY, f"substr({code}, 1, 2)")


TERM = pick(GROCERY_TERMS, "p_partkey")
PART_NAME = f"(p_name || ' ' || {TERM})"

_BASES = {word: base for word, (base, _) in UNIT_WORDS.items()}


def _factor(word: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN CAST({v!r} AS DOUBLE)" for k, (_, v) in UNIT_WORDS.items())
    return f"CASE {word} {whens} END"


def _num(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '.') AS DOUBLE)"


def parsed_unit(t: str) -> tuple[str, str]:
    """(quantity, unit) expressions for a normalised pack text."""
    multi = f"regexp_matches({t}, {lit(MULTIPACK)})"
    one = f"regexp_matches({t}, {lit(SINGLE)})"
    piece = f"regexp_matches({t}, {lit(PIECE)})"

    def m(i: int) -> str:
        return f"regexp_extract({t}, {lit(MULTIPACK)}, {i})"

    def o(i: int) -> str:
        return f"regexp_extract({t}, {lit(SINGLE)}, {i})"

    quantity = (
        f"CASE WHEN {multi} THEN {round3(f'TRY_CAST({m(1)} AS DOUBLE) * {_num(m(2))} * {_factor(m(3))}')} "
        f"WHEN {one} THEN {round3(f'{_num(o(1))} * {_factor(o(2))}')} "
        f"WHEN {piece} THEN 1.0::DOUBLE END"
    )
    unit = (
        f"CASE WHEN {multi} THEN {lookup(_BASES, m(3))} WHEN {one} THEN {lookup(_BASES, o(2))} "
        f"WHEN {piece} THEN 'buc' END"
    )
    return quantity, unit


# ---------------------------------------------------------------- catalogue views

FEED = f"""
feed AS (
  SELECT date_diff('day', DATE '{FEED_EPOCH}', CAST(l_shipdate AS DATE)) AS day, l_orderkey, l_linenumber,
         CAST(s_nationkey + 1 AS BIGINT) AS chain_id, l_partkey AS part,
         CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_suppkey + 1 END AS store_id,
         {round2('l_extendedprice / l_quantity')} AS price, l_shipdate, l_linestatus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""

VIEWS = f"""
chains AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, lower(replace(n_name, '_', '-')) AS slug, n_name AS name
  FROM nation
), stores AS (
  SELECT s_suppkey + 1 AS id, CAST(s_nationkey + 1 AS BIGINT) AS supermarket_id, CAST(s_suppkey AS VARCHAR) AS external_id, s_name AS name,
         {pick(CITIES, 's_suppkey')} AS city, {county_of(postal_code('s_suppkey'))} AS county,
         {postal_code('s_suppkey')} AS postal_code
  FROM supplier
), {FEED}, described AS (
  SELECT p_partkey, {PART_NAME} AS name, p_brand AS brand, p_type AS raw_category,
         CAST(p_size AS VARCHAR) || ' g' AS unit_size, {round3('p_size * 0.001::DOUBLE')} AS quantity,
         {norm('p_brand')} || ' ' || {norm(PART_NAME)} AS normalized_name,
         coalesce({rule_case(norm('p_type'))}, {category_of(norm(PART_NAME))}) AS category
  FROM part
), products AS (
  SELECT part * 100 + chain_id AS id, chain_id AS supermarket_id, CAST(part AS VARCHAR) AS external_id, name,
         normalized_name, brand, category, raw_category, unit_size, quantity, 'kg' AS unit
  FROM (SELECT DISTINCT chain_id, part FROM feed) JOIN described ON part = p_partkey
), prices AS (
  SELECT part * 100 + chain_id AS product_id, store_id, price, l_shipdate AS updated_at
  FROM feed
  QUALIFY row_number() OVER (PARTITION BY chain_id, part, store_id
                             ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, price DESC) = 1
)"""


# ---------------------------------------------------------------- text functions

def normalize_documents() -> str:
    return f"""
SELECT doc_id, {norm('text')} AS normalized,
       CAST(len(list_filter(string_split({norm('text')}, ' '), lambda x: x <> '')) AS BIGINT) AS n_tokens
FROM documents"""


def categorize_documents() -> str:
    return f"SELECT doc_id, {category_of(norm('text'))} AS category FROM documents"


def category_counts() -> str:
    return f"""
SELECT category, count(*) AS n_documents FROM ({categorize_documents()}) GROUP BY category"""


def page_texts() -> str:
    bare = "replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&')"
    return f"SELECT page_id, trim(regexp_replace({bare}, {lit(f'[{JS_SPACE}]+')}, ' ', 'g')) AS text FROM pages"


UNIT_TEXTS = [
    "{n} g", "{n}ml", "{n}X1,5 L", "{n} x 100 gr", "set {n} buc", "la bucata", "{n},5 kg",
    "{n} litri", "{n} role", "{n} Ouă", "cutie {n}", "{n} cl",
]


def parse_units() -> str:
    text = pick([t.replace("{n}", "#") for t in UNIT_TEXTS], "p_partkey")
    q, u = parsed_unit("t")
    return f"""
WITH texts AS (
  SELECT p_partkey, p_retailprice, replace({text}, '#', CAST(p_size AS VARCHAR)) AS unit_text FROM part
), parsed AS (
  SELECT *, {q} AS quantity, {u} AS unit FROM (SELECT *, {norm('unit_text')} AS t FROM texts)
)
SELECT p_partkey, unit_text, quantity, unit,
       CASE WHEN quantity > 0 THEN {round2('p_retailprice / quantity')} END AS price_per_unit
FROM parsed"""


def county_resolution() -> str:
    city = pick(CITIES + ["Atlantida"], "c_custkey")
    code = postal_code("c_custkey")
    return f"""
WITH c AS (
  SELECT c_custkey, {city} AS city,
         CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'RO ' || {code} ELSE {code} || '9' END AS code,
         CASE WHEN c_custkey % 10 = 0 THEN 'Cluj' ELSE '' END AS given
  FROM customer
), d AS (
  SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS digits FROM c
)
SELECT c_custkey, city, code AS postal_code,
       coalesce(nullif(given, ''),
                CASE WHEN length(digits) = 6 THEN {county_of('digits')} END,
                {lookup(CITY_COUNTY, norm('city'))}) AS county
FROM d"""


# ---------------------------------------------------------------- search

#: hits per query that the registered searches ask for
TOP_HITS = 60

TERM_ROWS = (
    "queries AS (SELECT CAST(i AS BIGINT) AS query_id, "
    f"({sql_list(GROCERY_TERMS)})[i + 1] AS q FROM range({len(GROCERY_TERMS)}) t(i))"
)


def search_sql(
    queries: str,
    prefix: bool = False,
    strict: bool = False,
    category: str = "NULL",
    supermarket: str = "NULL",
    county: str = "NULL",
    city: str = "NULL",
    limit: int = TOP_HITS,
    columns: str = "query_id, q, hit_no, id AS product_id, store_id, slug, name, price, match_rank",
) -> str:
    """Text scan of every product for every query, then the two cuts."""
    tail = "" if prefix else " || ' '"
    plain = f"instr(' ' || normalized_name || ' ', ' ' || t{tail}) > 0"
    like = "instr(' ' || normalized_name || ' ', '% ' || nq || '%') > 0" if prefix else (
        "instr(' ' || normalized_name || ' ', ' ' || nq || ' ') > 0"
    )
    pos = f"list_transform(tokens, lambda t: instr(' ' || normalized_name || ' ', ' ' || t{tail}))"
    return f"""
WITH {VIEWS}, {queries}, normal AS (
  SELECT *, {norm('q')} AS nq, {category} AS want_category, {supermarket} AS want_chain,
         {county} AS want_county, {city} AS want_city FROM queries
), prepared AS (
  SELECT *, list_filter(string_split(nq, ' '), lambda x: x <> '') AS tokens, {category_of('nq')} AS slug_of_query
  FROM normal
), names AS (
  SELECT DISTINCT normalized_name, category FROM products
), matched AS (
  SELECT p.*, n.normalized_name, n.category, list_min({pos}) AS position
  FROM prepared p JOIN names n ON
    CASE WHEN len(tokens) = 1 AND slug_of_query <> '{FALLBACK}' AND NOT {str(strict).lower()}
         THEN {like} OR n.category = slug_of_query
         ELSE len(list_filter(tokens, lambda t: {plain})) = len(tokens) END
  WHERE len(tokens) > 0 AND (want_category IS NULL OR n.category = want_category)
), ranked AS (
  SELECT m.query_id, m.q, p.id, c.slug, p.name, r.store_id, r.price,
         CAST(CASE WHEN slug_of_query <> '{FALLBACK}' AND p.category <> slug_of_query THEN 1000 ELSE 0 END
              + CASE WHEN position = 0 THEN {NO_POSITION} ELSE position END AS BIGINT) AS match_rank
  FROM matched m JOIN products p USING (normalized_name, category)
  JOIN chains c ON c.id = p.supermarket_id
  JOIN prices r ON r.product_id = p.id
  LEFT JOIN stores s ON s.id = r.store_id
  WHERE (want_chain IS NULL OR c.slug = want_chain)
    AND (want_county IS NULL OR r.store_id = 0 OR s.county = want_county)
    AND (want_city IS NULL OR r.store_id = 0 OR s.city = want_city)
), capped AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_rank, price, id, store_id) AS n
  FROM ranked
), firsts AS (
  SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY n) = 1
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS hit_no FROM firsts
)
SELECT {columns} FROM numbered WHERE hit_no <= {limit}"""


ORDER_COUNTY = f"""order_county AS (
  SELECT o_orderkey, {county_of(postal_code('o_custkey'))} AS county FROM orders
)"""

BASKETS = f"""
{ORDER_COUNTY}, adds AS (
  SELECT l_orderkey AS basket_id, date_diff('day', DATE '{FEED_EPOCH}', CAST(l_shipdate AS DATE)) AS day,
         l_linenumber, l_quantity AS qty, county,
         CASE WHEN p_partkey % 2 = 0 THEN {TERM} ELSE {PART_NAME} END AS query
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN order_county ON l_orderkey = o_orderkey
), lines AS (
  SELECT basket_id, lower(query) AS query, county, sum(qty) AS qty, min((day, l_linenumber)) AS at
  FROM adds GROUP BY ALL
)"""

# strict best row per (distinct query, county, chain)
FOUND = f"""
asked AS (SELECT DISTINCT query FROM lines),
asked_norm AS (
  SELECT query, string_split({norm('query')}, ' ') AS tokens, {category_of(norm('query'))} AS slug_of_query FROM asked
), strict_names AS (
  SELECT query, normalized_name, category,
         CASE WHEN slug_of_query <> '{FALLBACK}' AND category <> slug_of_query THEN 1000 ELSE 0 END
         + list_min(list_transform(tokens, lambda t: instr(' ' || normalized_name || ' ', ' ' || t || ' '))) AS match_rank
  FROM asked_norm JOIN (SELECT DISTINCT normalized_name, category FROM products)
    ON len(list_filter(tokens, lambda t: instr(' ' || normalized_name || ' ', ' ' || t || ' ') = 0)) = 0
), strict_offers AS (
  SELECT query, p.supermarket_id, match_rank, r.price, p.id AS product_id, r.store_id, s.county AS store_county
  FROM strict_names JOIN products p USING (normalized_name, category)
  JOIN prices r ON r.product_id = p.id LEFT JOIN stores s ON s.id = r.store_id
), wanted AS (SELECT DISTINCT query, county FROM lines),
strict_places AS (
  SELECT query, supermarket_id, store_county, store_id = 0 AS national,
         min((match_rank, price, product_id, store_id)) AS best
  FROM strict_offers GROUP BY ALL
), found AS (
  SELECT w.query, w.county, o.supermarket_id, min(best) AS best
  FROM wanted w JOIN strict_places o ON o.query = w.query
   AND (w.county IS NULL OR national OR store_county = w.county)
  GROUP BY ALL
)"""

COMPARED = f"""
compared AS (
  SELECT l.basket_id, c.id AS supermarket_id, c.slug, c.name,
         {round2('coalesce(sum(struct_extract_at(f.best, 2) * l.qty), 0)')} AS total,
         count(f.best) AS found_count, count(*) AS item_count
  FROM lines l CROSS JOIN chains c
  LEFT JOIN found f ON f.query = l.query AND f.county IS NOT DISTINCT FROM l.county AND f.supermarket_id = c.id
  GROUP BY l.basket_id, c.id, c.slug, c.name
), chain_ranked AS (
  SELECT *, item_count - found_count AS missing_count,
         row_number() OVER (PARTITION BY basket_id ORDER BY found_count DESC, total, name, supermarket_id) AS chain_rank
  FROM compared
)"""


def basket_compare() -> str:
    return f"""
WITH {VIEWS}, {BASKETS}, {FOUND}, {COMPARED}
SELECT basket_id, slug, total, found_count, missing_count, chain_rank FROM chain_ranked"""


def basket_top3() -> str:
    return f"""
WITH {VIEWS}, {BASKETS}, {FOUND}, {COMPARED}
SELECT basket_id, slug, total, found_count, chain_rank FROM chain_ranked
WHERE found_count > 0 AND chain_rank <= 3"""


# best loose match of every missed query, per (stem, county, chain)
ALTERNATIVE = f"""
missed AS (
  SELECT w.query, w.county, c.id AS supermarket_id
  FROM wanted w CROSS JOIN chains c
  ANTI JOIN found f ON f.query = w.query AND f.county IS NOT DISTINCT FROM w.county AND f.supermarket_id = c.id
), stems AS (
  SELECT query, list_filter(string_split({norm('query')}, ' '), lambda x: length(x) >= 3) AS words FROM asked
), stemmed AS (
  SELECT query, words[list_position(list_transform(words, lambda x: length(x)),
                                    list_max(list_transform(words, lambda x: length(x))))] AS longest
  FROM stems WHERE len(words) > 0
), cut AS (
  SELECT query, substr(longest, 1, greatest(4, length(longest) - 2)) AS stem FROM stemmed
), loose AS (
  SELECT DISTINCT stem, {category_of('stem')} AS slug_of_query FROM cut
), loose_names AS (
  SELECT stem, normalized_name, category, slug_of_query, instr(' ' || normalized_name, ' ' || stem) AS position
  FROM loose JOIN (SELECT DISTINCT normalized_name, category FROM products) ON
    CASE WHEN slug_of_query <> '{FALLBACK}'
         THEN category = slug_of_query OR instr(' ' || normalized_name || ' ', '% ' || stem || '%') > 0
         ELSE instr(' ' || normalized_name, ' ' || stem) > 0 END
), loose_places AS (
  SELECT stem, p.supermarket_id, s.county AS store_county, r.store_id = 0 AS national,
         min((CASE WHEN slug_of_query <> '{FALLBACK}' AND n.category <> slug_of_query THEN 1000 ELSE 0 END
              + CASE WHEN position = 0 THEN {NO_POSITION} ELSE position END,
              r.price, p.id, r.store_id)) AS best
  FROM loose_names n JOIN products p USING (normalized_name, category)
  JOIN prices r ON r.product_id = p.id LEFT JOIN stores s ON s.id = r.store_id
  GROUP BY ALL
), loose_wanted AS (
  SELECT DISTINCT stem, county, supermarket_id FROM missed JOIN cut USING (query)
), loose_found AS (
  SELECT w.stem, w.county, w.supermarket_id, min(best) AS best
  FROM loose_wanted w JOIN loose_places o ON o.stem = w.stem AND o.supermarket_id = w.supermarket_id
   AND (w.county IS NULL OR national OR store_county = w.county)
  GROUP BY ALL
), suggested AS (
  SELECT m.query, m.county, m.supermarket_id, cut.stem, best
  FROM missed m JOIN cut USING (query)
  JOIN loose_found f ON f.stem = cut.stem AND f.supermarket_id = m.supermarket_id
   AND f.county IS NOT DISTINCT FROM m.county
)"""


def alternatives() -> str:
    return f"""
WITH {VIEWS}, {BASKETS}, {FOUND}, {ALTERNATIVE}
SELECT query, county, supermarket_id, stem, CAST(struct_extract_at(best, 1) AS BIGINT) AS alt_rank,
       struct_extract_at(best, 2) AS alt_price, struct_extract_at(best, 3) AS alt_product_id,
       struct_extract_at(best, 4) AS alt_store_id
FROM suggested"""


def basket_missing() -> str:
    return f"""
WITH {VIEWS}, {BASKETS}, {FOUND}, {ALTERNATIVE}
SELECT l.basket_id, c.id AS supermarket_id, count(*) - count(f.best) AS missing_count,
       count(CASE WHEN f.best IS NULL THEN a.best END) AS alternative_count
FROM lines l CROSS JOIN chains c
LEFT JOIN found f ON f.query = l.query AND f.county IS NOT DISTINCT FROM l.county AND f.supermarket_id = c.id
LEFT JOIN suggested a ON a.query = l.query AND a.county IS NOT DISTINCT FROM l.county AND a.supermarket_id = c.id
GROUP BY l.basket_id, c.id"""


def basket_assembly() -> str:
    return f"""
WITH {BASKETS}
SELECT basket_id, CAST(count(*) AS BIGINT) AS n_lines, sum(qty) AS item_total FROM lines GROUP BY basket_id"""


# ---------------------------------------------------------------- merge

#: first day of the second batch
SECOND_BATCH = "1998-06-01"

SAVED_ROWS = f"""
slugs AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS chain_id, lower(replace(n_name, '_', '-')) AS slug,
         row_number() OVER (ORDER BY lower(replace(n_name, '_', '-'))) AS supermarket_id FROM nation
), rows_in AS (
  SELECT slug, supermarket_id, CAST(part AS VARCHAR) AS external_id,
         CASE WHEN l_shipdate < DATE '{SECOND_BATCH}' THEN 1 ELSE 2 END AS batch,
         CAST(day AS BIGINT) * 281474976710656 + l_orderkey * 16 + l_linenumber AS seq,
         {PART_NAME} || CASE WHEN l_linestatus = 'O' THEN ' promo' ELSE '' END AS name,
         CASE WHEN l_linenumber % 3 <> 0 THEN p_brand END AS brand, p_type AS raw_category,
         CASE WHEN l_linenumber % 2 <> 0 THEN CAST(p_size AS VARCHAR) || ' g' END AS unit_size,
         CASE WHEN l_linenumber % 2 <> 0 THEN {round3('p_size * 0.001::DOUBLE')} END AS quantity,
         CASE WHEN store_id = 0 THEN 'national' ELSE CAST(store_id - 1 AS VARCHAR) END AS store_ref, price
  FROM feed JOIN slugs USING (chain_id) JOIN part ON part = p_partkey
)"""


def save_products() -> str:
    return f"""
WITH {FEED}, {SAVED_ROWS}, folded AS (
  SELECT slug, supermarket_id, external_id, arg_max(name, seq) AS name,
         arg_max(CASE WHEN brand IS NULL THEN {norm('name')} ELSE {norm('brand')} || ' ' || {norm('name')} END, seq) AS normalized_name,
         arg_max(coalesce({rule_case(norm('raw_category'))}, {category_of(norm('name'))}), seq) AS category,
         arg_max(brand, seq) FILTER (brand IS NOT NULL) AS brand,
         arg_max(unit_size, seq) FILTER (unit_size IS NOT NULL) AS unit_size,
         arg_max(quantity, seq) FILTER (quantity IS NOT NULL) AS quantity, min(seq) AS first_seq
  FROM rows_in GROUP BY ALL
)
SELECT row_number() OVER (ORDER BY first_seq, supermarket_id, external_id) AS id, slug, external_id, name,
       normalized_name, category, brand, unit_size, quantity
FROM folded"""


def save_prices() -> str:
    return f"""
WITH {FEED}, {SAVED_ROWS}
SELECT slug, external_id, store_ref, max(batch) AS batch, arg_max(price, seq) AS price,
       arg_max({{'v': {round2('price / quantity')}}}, seq).v AS price_per_unit
FROM rows_in GROUP BY slug, external_id, store_ref"""


def price_history() -> str:
    return f"""
WITH {FEED}, {SAVED_ROWS}, walked AS (
  SELECT *, lag(price) OVER (PARTITION BY slug, external_id, store_ref ORDER BY seq) AS previous FROM rows_in
)
SELECT slug, external_id, store_ref, batch, price FROM walked
WHERE previous IS NULL OR abs(previous - price) > 0.001"""


# ---------------------------------------------------------------- edits and reports


def patch_products() -> str:
    """Every tenth part gets a new name and brand, every seventh a new size and price."""
    renamed = "(id % 10 = 3)"
    priced = "(id % 7 = 2)"
    return f"""
WITH {VIEWS}, {EDITED_SIZES}
SELECT p.id, CASE WHEN {renamed} THEN 'Ediție ' || p.name ELSE p.name END AS name,
       CASE WHEN {renamed} THEN 'acme edit ' || {norm('p.name')} ELSE normalized_name END AS normalized_name,
       CASE WHEN {renamed} THEN 'Acme' ELSE brand END AS brand,
       CASE WHEN {priced} THEN new_size ELSE unit_size END AS unit_size,
       CASE WHEN {priced} THEN new_quantity ELSE quantity END AS quantity,
       CASE WHEN {priced} THEN 5.5 ELSE r.price END AS national_price,
       CASE WHEN {priced} THEN {round2('5.5 / new_quantity')} ELSE {round2('r.price / quantity')} END AS national_unit_price,
       CAST(CASE WHEN {priced} THEN 1 ELSE 0 END AS BIGINT) AS logged
FROM products p JOIN sizes ON sizes.id2 = p.id
LEFT JOIN prices r ON r.product_id = p.id AND r.store_id = 0""".replace("edit ' || ", "editie ' || ")


EDITED_SIZES = f"""sizes AS (
  SELECT id AS id2, CAST(id % 4 + 1 AS VARCHAR) || ' kg' AS new_size, CAST(id % 4 + 1 AS DOUBLE) AS new_quantity FROM products
)"""


def create_products() -> str:
    """One product per distinct part name in the first chain."""
    return f"""
WITH made AS (
  SELECT p_name || ' nou' AS name, min(p_retailprice) AS price FROM part GROUP BY p_name
)
SELECT 'admin-' || replace({norm('name')}, ' ', '-') AS external_id, name, {norm('name')} AS normalized_name,
       {category_of(norm('name'))} AS category, 1.0::DOUBLE AS quantity, 'l' AS unit, price, price AS price_per_unit
FROM made"""


def delete_products() -> str:
    return f"""
WITH {VIEWS}
SELECT (SELECT count(*) FROM products WHERE id % 3 <> 0) AS products,
       (SELECT count(*) FROM prices WHERE product_id % 3 <> 0) AS prices,
       (SELECT round(sum(price * 100)) FROM prices WHERE product_id % 3 <> 0) AS price_sum"""


def recompute_categories() -> str:
    """Stored categories start as 'altele' for every part not divisible by four."""
    return f"""
WITH {VIEWS}
SELECT count(*) FILTER (WHERE (part_no % 4 <> 0 AND category <> 'altele')) AS changed, count(*) AS products
FROM (SELECT *, CAST(external_id AS BIGINT) AS part_no FROM products)"""


def meta_counts() -> str:
    return f"""
WITH {VIEWS}
SELECT 'supermarket' AS kind, slug AS value, count(p.id) AS n FROM chains LEFT JOIN products p ON p.supermarket_id = chains.id GROUP BY slug
UNION ALL SELECT DISTINCT 'city', city, 1 FROM stores
UNION ALL SELECT DISTINCT 'county', county, 1 FROM stores WHERE county IS NOT NULL
UNION ALL SELECT 'last_update', strftime(max(updated_at), '%Y-%m-%d'), 1 FROM prices"""


def admin_page() -> str:
    return f"""
WITH {VIEWS}
SELECT p.id, p.name, p.brand, p.category, p.unit_size, c.name AS supermarket,
       (SELECT min(price) FROM prices WHERE product_id = p.id) AS price,
       (SELECT max(updated_at) FROM prices WHERE product_id = p.id) AS updated_at
FROM products p JOIN chains c ON c.id = p.supermarket_id
WHERE normalized_name LIKE '%ring lap%' ORDER BY p.id DESC LIMIT 50 OFFSET 10"""


def supermarket_report() -> str:
    return f"""
WITH {VIEWS}
SELECT c.id, c.slug, c.name, count(DISTINCT p.id) AS products, count(DISTINCT st.id) AS stores, count(DISTINCT st.city) AS cities
FROM chains c LEFT JOIN (SELECT id, supermarket_id FROM products) p ON p.supermarket_id = c.id
LEFT JOIN stores st ON st.supermarket_id = c.id GROUP BY c.id, c.slug, c.name"""


def last_runs() -> str:
    return """
SELECT event_id + 1 AS id, event_type AS supermarket, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
       CAST(floor(value) AS BIGINT) AS products_found, props AS message
FROM events ORDER BY id DESC LIMIT 10"""


def quality_gate() -> str:
    return f"""
WITH {FEED}, extracted AS (
  SELECT chain_id, count(*) AS extracted FROM feed GROUP BY chain_id
), floors AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS chain_id, lower(replace(n_name, '_', '-')) AS supermarket_slug,
         (SELECT count(*) // 25 FROM lineitem) - 60 + n_nationkey * 5 AS min_products,
         list_transform(range(n_nationkey % 7), lambda i: 'w' || i) AS warnings
  FROM nation
), judged AS (
  SELECT *, coalesce(extracted, 0) AS n, coalesce(extracted, 0) >= greatest(min_products, 1) AS ok
  FROM floors LEFT JOIN extracted USING (chain_id)
)
SELECT supermarket_slug, n AS extracted, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN ok THEN nullif(array_to_string(warnings[1:5], ' | '), '')
            ELSE 'doar ' || n || ' produse extrase (minim așteptat: ' || min_products || ') — rulare incompletă, prețurile existente rămân neatinse. '
                 || array_to_string(warnings[1:3], ' | ') END AS message,
       CASE WHEN ok THEN n ELSE 0 END AS passed
FROM judged"""


def gate_overall() -> str:
    return f"""
SELECT bool_and(status = 'ok') AS all_ok, count(*) FILTER (status = 'ok') AS succeeded, count(*) AS requested
FROM ({quality_gate()})"""


def import_summary() -> str:
    return f"""
WITH {FEED}, {SAVED_ROWS}
SELECT slug AS supermarket_slug, count(*) AS products FROM rows_in GROUP BY ROLLUP (slug)"""


# ---------------------------------------------------------------- feeds


def representative_store() -> str:
    return f"""
WITH s AS (
  SELECT 'RO' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS n, c_name AS cn, {county_of(postal_code('c_custkey'))} AS county FROM customer
)
SELECT n, cn, county FROM s WHERE county IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY county ORDER BY n) = 1"""


def offer_availability() -> str:
    return """
WITH listed AS (
  SELECT DISTINCT l_partkey, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS store_n FROM lineitem
)
SELECT CAST(p_partkey AS VARCHAR) AS kl_nr, string_agg(store_n, ',' ORDER BY store_n) AS stores
FROM part LEFT JOIN listed ON l_partkey = p_partkey GROUP BY p_partkey"""


def csv_roundtrip() -> str:
    return """
SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name || ', "' || p_brand || '"' || chr(10) || 'x' AS name, p_brand AS brand,
       p_type AS raw_category, CAST(p_size AS VARCHAR) || ' g' AS unit_size_text, p_retailprice AS price,
       CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 END AS old_price,
       'harvester-cluj-napoca' AS store
FROM part"""


def feed_lidl() -> str:
    return """
SELECT CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'E' || p_partkey ELSE 'C' || p_partkey END AS external_id,
       p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS brand, p_type AS raw_category,
       p_size || ' g' AS unit_size_text, p_retailprice AS price,
       CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 END AS old_price, 'RON' AS currency,
       'https://www.lidl.ro/p/' || p_partkey AS url,
       strftime(TIMESTAMP '1970-01-01' + to_seconds(1700000000 + p_partkey * 3600), '%Y-%m-%d') AS valid_from
FROM part WHERE p_partkey % 7 > 1"""


def feed_auchan() -> str:
    return """
SELECT 'A' || p_partkey AS external_id, p_name AS name, p_brand AS brand, p_type AS raw_category,
       CASE p_partkey % 3 WHEN 0 THEN p_name ELSE
            CASE WHEN p_size % 10 = 0 THEN CAST(p_size // 10 AS VARCHAR) ELSE CAST(p_size / 10.0 AS VARCHAR) END || ' kg' END AS unit_size_text,
       p_retailprice AS price, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 5 END AS old_price,
       'https://www.auchan.ro/l' || p_partkey || '/p' AS url
FROM part WHERE p_partkey % 7 > 0"""


def feed_penny() -> str:
    return """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'S' || p_partkey ELSE 'P' || p_partkey END AS external_id,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name,
       CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 END || ' kg' ELSE p_size || ' buc' END AS unit_size_text,
       (p_size * 100 + 99) / 100.0::DOUBLE AS price,
       CASE WHEN p_partkey % 3 = 0 THEN (p_size * 10) / 100.0::DOUBLE END AS unit_price,
       CASE WHEN p_partkey % 3 = 0 THEN 'l' END AS per_unit
FROM part WHERE p_partkey % 11 <> 0"""


def feed_profi() -> str:
    return """
WITH p AS (
  SELECT *, p_partkey // 40 AS page, p_name || ' ' || p_partkey AS name FROM part
)
SELECT CASE WHEN page % 2 = 1 THEN lower(replace(name, ' ', '-')) WHEN p_partkey % 9 = 0 THEN name
            ELSE 'PF' || p_partkey END AS external_id,
       name, CASE WHEN page % 2 = 0 AND p_partkey % 3 <> 0 THEN p_brand END AS brand,
       CASE WHEN page % 2 = 0 THEN p_retailprice ELSE CAST(p_size || '.99' AS DOUBLE) END AS price
FROM p WHERE page % 7 <> 3 AND NOT (page % 2 = 1 AND p_partkey % 10 = 3)"""


def feed_kaufland() -> str:
    return f"""
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'K' || p_partkey ELSE 'O' || p_partkey END AS external_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'K' || p_partkey ELSE '' END AS kl_nr,
       CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand || ' ' || p_name || ' ' || p_size || ' G' END AS name,
       p_type AS raw_category,
       nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || ' ' || p_size || ' G bax' END, '') AS unit_size_text,
       p_retailprice AS price,
       {round2('p_retailprice / (p_size * 0.001::DOUBLE)')} AS unit_price, 'kg' AS per_unit
FROM part"""


def jsonld_products() -> str:
    return """
SELECT p_partkey AS page_id, 'L' || p_partkey AS external_id, p_name || ' ' || p_size || ' g' AS name, p_brand AS brand,
       p_retailprice AS price, p_size || ' g' AS unit_size, 'https://cdn.example.com/' || p_partkey || '.png' AS image_url
FROM part"""


def json_arrays() -> str:
    return f"""
SELECT p_partkey // 50 AS body_id, 'J' || p_partkey AS external_id, p_name AS name, p_brand AS brand,
       {round2('p_retailprice')} AS price, 'https://shop.example.com/p/' || p_partkey AS url
FROM part"""


def dom_cards() -> str:
    return """
SELECT DISTINCT p_partkey // 40 AS page_id, p_name || ' ' || p_brand AS name, p_size + 0.99::DOUBLE AS price FROM part"""


def merge_sources() -> str:
    return """
SELECT CAST(p_partkey AS VARCHAR) AS product_key, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS source_rank,
       CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_retailprice + 1 END AS price
FROM part"""


def page_links() -> str:
    return r"""
WITH p AS (
  SELECT page_id, html, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS origin FROM pages
), h AS (
  SELECT page_id, origin, unnest(regexp_extract_all(html, 'href="(https?://[^"]+|/[^"]+)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, 'href="(https?://[^"]+|/[^"]+)"', 1), 1) AS pos
  FROM p
), a AS (
  SELECT page_id, origin, pos, regexp_replace(CASE WHEN href[1] = '/' THEN origin || href ELSE href END, '#.*$', '') AS link FROM h
), o AS (
  SELECT *, lower(regexp_extract(link, '^([a-zA-Z]+://[^/?#]+)', 1)) AS own FROM a
), e AS (
  SELECT page_id, origin, pos, own || array_to_string(list_transform(string_split(CASE WHEN substr(link, length(own) + 1, 1) = '/' THEN substr(link, length(own) + 1) ELSE '/' || substr(link, length(own) + 1) END, ''),
         lambda c: CASE WHEN regexp_matches(c, '^[!$-;=?-_a-z|~%]$') THEN c ELSE url_encode(c) END), '') AS link
  FROM o WHERE own = origin
), d AS (
  SELECT origin AS site, link, min((page_id, pos)) AS found_at FROM e
  WHERE regexp_matches(regexp_extract(link, '^[^/]*//[^/?]*([^?]*)', 1), '(?i)/[a-s]')
    AND NOT regexp_matches(link, '(?i)\.(pdf|jpg|png|webp|css|js)(\?|$)')
  GROUP BY ALL
)
SELECT site, link, row_number() OVER (PARTITION BY site ORDER BY found_at) AS link_no FROM d"""


page_links_all = page_links


def stream_ingest() -> str:
    return f"""
WITH {VIEWS}
SELECT c.slug, p.external_id, CASE WHEN r.store_id = 0 THEN 'national' ELSE s.external_id END AS store_ref, r.price
FROM prices r JOIN products p ON p.id = r.product_id JOIN chains c ON c.id = p.supermarket_id
LEFT JOIN stores s ON s.id = r.store_id"""


# ---------------------------------------------------------------- further operators


def category_browse() -> str:
    return f"""
WITH {VIEWS}, ranked AS (
  SELECT p.category, p.id, r.store_id, r.price,
         row_number() OVER (PARTITION BY p.category ORDER BY r.price, p.id, r.store_id) AS n
  FROM products p JOIN prices r ON r.product_id = p.id LEFT JOIN stores s ON s.id = r.store_id
  WHERE r.store_id = 0 OR s.county = 'Cluj'
), firsts AS (
  SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY category, id ORDER BY n) = 1
)
SELECT category, id AS product_id, store_id, price, row_number() OVER (PARTITION BY category ORDER BY n) AS hit_no
FROM firsts QUALIFY hit_no <= {TOP_HITS}"""


def product_labels() -> str:
    return f"""
WITH {VIEWS}
SELECT p.id, r.store_id, CASE WHEN contains(lower(name), lower(brand)) THEN name ELSE brand || ' ' || name END AS label,
       CASE WHEN p.id % 3 = 2 THEN r.price + 1 END AS shown_old_price
FROM products p JOIN prices r ON r.product_id = p.id"""


def offers_csv() -> str:
    return f"""
SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name || ' ' || p_size || ' g' AS name, p_size || ' g' AS unit_size,
       p_retailprice AS price, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 END AS old_price, p_type AS category
FROM part"""


def save_stores() -> str:
    return f"""
WITH slugs AS (
  SELECT CAST(n_nationkey AS BIGINT) AS chain, lower(replace(n_name, '_', '-')) AS slug FROM nation
)
SELECT slug, CAST(s_suppkey AS VARCHAR) AS external_id, s_name || ' nou' AS name, {pick(CITIES, 's_suppkey + 1')} AS city,
       coalesce({lookup(CITY_COUNTY, norm(pick(CITIES, 's_suppkey + 1')))}, {county_of(postal_code('s_suppkey'))}) AS county,
       {postal_code('s_suppkey')} AS postal_code
FROM supplier JOIN slugs ON chain = s_nationkey"""


def run_log() -> str:
    return f"""
WITH {FEED}, valid AS (
  SELECT chain_id, count(DISTINCT part) AS saved, count(*) AS extracted FROM feed GROUP BY chain_id
), judged AS (
  SELECT lower(replace(n_name, '_', '-')) AS supermarket, coalesce(saved, 0) AS saved, coalesce(extracted, 0) AS extracted,
         greatest(n_nationkey * 200, 1) AS floor_n
  FROM nation LEFT JOIN valid ON chain_id = n_nationkey + 1
)
SELECT row_number() OVER (ORDER BY supermarket) AS id, supermarket,
       CASE WHEN extracted >= floor_n THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN extracted >= floor_n THEN saved ELSE 0 END AS products_found
FROM judged"""


def store_gate() -> str:
    return """
WITH listed AS (SELECT DISTINCT o_custkey FROM orders)
SELECT count(*) AS stores, count(*) FILTER (WHERE o_custkey IS NULL) AS failures,
       count(*) FILTER (WHERE o_custkey IS NULL) <= count(*) * 0.2 AS gate_ok
FROM customer LEFT JOIN listed ON o_custkey = c_custkey"""


def runners_up() -> str:
    return f"""
WITH {VIEWS}, {BASKETS}, {FOUND}, {COMPARED}
SELECT slug, chain_rank, count(*) AS baskets FROM chain_ranked WHERE found_count > 0 AND chain_rank > 3
GROUP BY slug, chain_rank"""


def csv_order() -> str:
    return """
SELECT CAST(p_partkey AS VARCHAR) AS external_id,
       p_retailprice + CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS price,
       1 + CAST(p_partkey % 2 = 0 AS BIGINT) + CAST(p_partkey % 4 = 0 AS BIGINT) AS deliveries
FROM part"""
