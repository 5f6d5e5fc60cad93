"""Product cards in page markup.

A small HTML walk per page emits the leaf cards and their raw texts; which
price, which title, sanity and deduplication are DataFrame work. Rendered text
is approximated: block tags break lines, other tags do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import parse_price
from shelfwise.functions.text import JS_SPACE, fallback_product_id, js_trim, origin_of
from shelfwise.functions.units import unit_from_name
from shelfwise.operators.keyed import first_per_key
from shelfwise.schemas import HARVESTED_COLUMNS
from shelfwise.session import bound_batches

# Class fragments and tags of cards, titles and prices, and price patterns.
CARD_CLASSES = ("product", "offer", "card", "item")
INNER_CLASSES = ("product", "offer", "card")
CARD_TAGS = ("article", "li")
TITLE_TAGS = ("h1", "h2", "h3", "h4")
TITLE_CLASSES = ("title", "name", "denumire")
OWN_TITLE_TAGS = ("h2", "h3", "h4")
OWN_TITLE_CLASSES = ("title", "name")
PRICE_CLASSES = ("price", "pret")
PRICE_DECIMAL = r"(?i)(?<!\d)(\d+[.,]\d{2})\s*(?:lei|ron)"
PRICE_WHOLE = r"(?i)(?<!\d)(\d+)\s*(?:lei|ron)"
BARE_DECIMAL = r"(?<!\d)(\d+[.,]\d{2})(?!\d)"
SPLIT_DECIMAL = r"(?<!\d)(\d+)\s+(\d{2})(?!\d)"
SHORTEST_NAME = 4

_BREAKS = frozenset(
    "address article aside blockquote br div dd dl dt fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tr ul".split()
)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_HIDDEN = frozenset("script style noscript template head".split())

CARD_SCHEMA = (
    "page_id bigint, url string, card_idx int, text string, price_text string, title string, "
    "image string, link string"
)


class _Node:
    __slots__ = ("tag", "classes", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = attrs.get("class") or ""
        self.children: list[_Node | str] = []

    def has_class(self, fragments: tuple[str, ...]) -> bool:
        return any(f in self.classes for f in fragments)

    def below(self) -> Iterator[_Node]:
        """Descendant elements in document order (iterative: pages may nest deeply)."""
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def pieces(self) -> Iterator[str]:
        """Text nodes, with a newline at each side of a block."""
        stack: list[_Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in _HIDDEN:
                around = ["\n"] if c.tag in _BREAKS else []
                stack.extend(around + list(reversed(c.children)) + around)

    def text(self) -> str:
        lines = ("".join(self.pieces())).split("\n")
        return "\n".join(t for t in (" ".join(x.split()) for x in lines) if t)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p") and self.at.tag == tag:  # implied end tags
            self.at = self.at.parent
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        # source line breaks are plain white space
        self.at.children.append(data.replace("\n", " "))


def _first(nodes: Iterator[_Node], test) -> _Node | None:
    return next((n for n in nodes if test(n)), None)


def leaf_cards(html: str, longest_card: int | None = None, own: bool = False) -> Iterator[tuple]:
    """Texts of the leaf cards of a page; ``own``: the narrower rules for a chain's own pages."""
    classes, tags, inner_tag = (INNER_CLASSES, (), None) if own else (CARD_CLASSES, CARD_TAGS, "article")
    title_tags = OWN_TITLE_TAGS if own else TITLE_TAGS
    title_classes = OWN_TITLE_CLASSES if own else TITLE_CLASSES
    builder = _Builder()
    builder.feed(html)
    builder.close()
    for el in builder.root.below():
        if not (el.has_class(classes) or el.tag in tags):
            continue
        if _first(el.below(), lambda n: n.has_class(INNER_CLASSES) or n.tag == inner_tag):
            continue
        text = el.text()
        if longest_card is not None and len(text) > longest_card:
            continue
        price = _first(el.below(), lambda n: n.has_class(PRICE_CLASSES))
        bits = [] if price is None else [p.strip() for p in price.pieces()]
        title = _first(el.below(), lambda n: n.tag in title_tags or n.has_class(title_classes))
        image = _first(el.below(), lambda n: n.tag == "img")
        link = _first(el.below(), lambda n: n.tag == "a" and "href" in n.attrs)
        yield (
            text,
            " ".join(b for b in bits if b),
            "" if title is None else title.text(),
            None if image is None else image.attrs.get("src"),
            None if link is None else link.attrs.get("href"),
        )


_COLUMNS = [c.split()[0] for c in CARD_SCHEMA.split(", ")]


#: cards handed back to Spark at a time
CARDS_OUT = 2000


def card_texts(pages: DataFrame, longest_card: int | None = None, own: bool = False) -> DataFrame:
    """Leaf cards of ``pages`` (page_id, url, html) with their raw texts; longer cards are left out.

    Pages come in batches bounded by bytes, and cards go back in parts of bounded length.
    """
    bound_batches(pages.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for page_id, url, html in zip(*[c.to_pylist() for c in batch.columns]):
                for i, card in enumerate(leaf_cards(html, longest_card, own) if html is not None else ()):
                    rows.append((page_id, url, i, *card))
                    if len(rows) == CARDS_OUT:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _COLUMNS)

    typed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return typed.mapInArrow(walk, CARD_SCHEMA)


def _match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def card_price(text: Column, price_text: Column) -> Column:
    """Price of a card: from its price element, else from ``N lei`` in its text.

    Split elements read as decimals (``12`` ``99`` -> 12.99).
    """
    pair = F.concat_ws(
        ".", _match(price_text, SPLIT_DECIMAL),
        F.nullif(F.regexp_extract(price_text, SPLIT_DECIMAL, 2), F.lit("")),
    )
    own = parse_price(
        F.coalesce(
            _match(price_text, PRICE_DECIMAL),
            _match(price_text, BARE_DECIMAL),
            F.nullif(pair, F.lit("")),
            _match(price_text, r"(\d+)"),
        )
    )
    in_text = parse_price(F.coalesce(_match(text, PRICE_DECIMAL), _match(text, PRICE_WHOLE)))
    return F.when(own > 0, own).otherwise(in_text)


def card_name(text: Column, title: Column, longest_name: int | None = None) -> Column:
    """Title of a card, else its longest plausible line."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), js_trim),
        lambda s: (F.length(s) >= 6) & ~F.rlike(s, F.lit(PRICE_WHOLE)) & ~F.rlike(s, F.lit(r"^\d")),
    )
    longest = F.aggregate(
        lines, F.lit(""), lambda best, s: F.when(F.length(s) > F.length(best), s).otherwise(best)
    )
    name = F.when(js_trim(title) != "", title).otherwise(longest)
    plain = js_trim(F.regexp_replace(name, f"[{JS_SPACE}]+", " "))
    return plain if longest_name is None else F.substring(plain, 1, longest_name)


def _absolute(link: Column, page_url: Column) -> Column:
    """Link as a browser would resolve it, for absolute and root-relative links."""
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(page_url, r"^([^?#]*/)", 1)
    return (
        F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin_of(page_url), link))
        .otherwise(F.concat(folder, link))
    )


def products_from_cards(
    pages: DataFrame, longest_card: int | None = None, longest_name: int | None = None
) -> DataFrame:
    """Harvested products of page cards; per page the first of equal (name, price) stays."""
    cards = card_texts(pages, longest_card)
    rows = cards.select(
        "page_id",
        F.col("card_idx").alias("item_seq"),
        F.lit(None).cast("string").alias("external_id"),
        card_name(F.col("text"), F.col("title"), longest_name).alias("name"),
        F.lit(None).cast("string").alias("brand"),
        card_price(F.col("text"), F.col("price_text")).alias("price"),
        F.lit(None).cast("double").alias("old_price"),
        F.lit(None).cast("string").alias("category"),
        _absolute(F.col("image"), F.col("url")).alias("image_url"),
        _absolute(F.col("link"), F.col("url")).alias("url"),
    ).withColumn("unit_size", unit_from_name(F.col("name")))
    sane = (F.col("price") > 0.05) & (F.col("price") < 30000)
    rows = rows.filter(sane & (F.length("name") >= SHORTEST_NAME))
    rows = rows.withColumn("_name", F.lower("name"))
    rows = first_per_key(rows, ["page_id", "_name", "price"], ["item_seq"])
    return rows.select("page_id", "item_seq", *HARVESTED_COLUMNS)


# The plainer reading of a chain's own pages.
OWN_PRICE = r"(?i)(\d+(?:[.,]\d{1,2})?)\s*(?:lei|ron)"


def offers_from_cards(pages: DataFrame, longest_card: int | None = None, own: bool = False) -> DataFrame:
    """Cards of a chain's own pages: a titled card with ``N lei`` in its text.

    ``own``: only elements with a card's class are cards, whatever their tag.
    """
    cards = card_texts(pages, longest_card, own)
    name = js_trim(F.col("title"))
    rows = cards.select(
        "page_id",
        F.col("card_idx").alias("item_seq"),
        fallback_product_id(name).alias("external_id"),
        name.alias("name"),
        F.lit(None).cast("string").alias("brand"),
        parse_price(_match(F.col("text"), OWN_PRICE)).alias("price"),
        F.lit(None).cast("double").alias("old_price"),
        F.lit(None).cast("string").alias("unit_size"),
        F.lit(None).cast("string").alias("category"),
        _absolute(F.col("image"), F.col("url")).alias("image_url"),
        F.lit(None).cast("string").alias("url"),
    ).filter((F.length("name") >= 3) & (F.col("price") > 0))
    return rows.select("page_id", "item_seq", *HARVESTED_COLUMNS)
