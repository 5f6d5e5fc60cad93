"""Links of stored pages that are worth visiting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import origin_of
from shelfwise.operators.keyed import assign_ids, first_per_key
from shelfwise.session import broadcast_if_small, materialize

# Links, static files, and per site the paths to follow and how many.
HREF = r'href="(https?://[^"]+|/[^"]+)"'
STATIC = r"(?i)\.(pdf|jpg|png|webp|css|js)(\?|$)"
SITES = {
    "profi": (r"(?i)/(oferte|revista|promotii|catalog|cupoane|coupon)", 12),
    "metro": (r"(?i)/(shop|promotii|oferte|categor|marketplace)", 12),
    "la-cocos": (r"(?i)/(produs|product|categ|shop|magazin|ofert|promo)", 15),
    "penny": (r"(?i)/(categorie|oferte|promo)", 4),
}

_PLAIN = r"^[!$-;=?-_a-z|~]*$"  # nothing a URL would percent-encode


def _encoded(url: Column) -> Column:
    """Percent-encode what a URL may not hold as is."""
    each = F.transform(
        F.split(url, ""),
        lambda c: F.when(F.rlike(c, F.lit(_PLAIN)) | (c == "%"), c).otherwise(
            F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
        ),
    )
    return F.when(F.rlike(url, F.lit(_PLAIN)), url).otherwise(F.array_join(each, ""))


def page_links(pages: DataFrame, discover: str, max_links: int | None) -> DataFrame:
    """(site, link_no, link): new links of each site in page order, the site's budget at most if there is one.

    ``pages``: site, page_seq, url, html. Same-origin links whose path matches
    ``discover`` and is no static file; fragments are dropped.
    """
    found = pages.select(
        "site",
        "page_seq",
        F.lower(origin_of(F.col("url"))).alias("origin"),
        F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"),
    )
    full = F.when(
        F.startswith("href", F.lit("/")), F.concat("origin", "href")
    ).otherwise(F.col("href"))
    bare = F.regexp_replace(full, "#.*$", "")
    own = F.lower(origin_of(bare))
    rest = F.substring(bare, F.length(own) + 1, F.length(bare))
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    links = found.withColumns({"link": F.concat(own, _encoded(rest)), "link_origin": own})
    path = F.regexp_extract("link", r"^[^/]*//[^/?]*([^?]*)", 1)
    links = links.filter(
        (F.col("link_origin") == F.col("origin"))
        & F.rlike(path, F.lit(discover))
        & ~F.rlike(path, F.lit(STATIC))
    )
    order = ["page_seq", "pos"]
    new = first_per_key(links.select("site", "link", *order), ["site", "link"], order)
    if max_links is None:  # a site may have any number, so no window over a site
        numbered = materialize(assign_ids(new, 0, ["site", *order, "link"], "_id"), "links")
        first = broadcast_if_small(numbered.groupBy("site").agg(F.min("_id").alias("_first")))
        number = (F.col("_id") - F.col("_first") + 1).cast("int")
        return numbered.join(first, "site").select("site", number.alias("link_no"), "link")
    numbered = new.withColumn(
        "link_no", F.row_number().over(Window.partitionBy("site").orderBy(*order))
    )
    return numbered.filter(F.col("link_no") <= max_links).select("site", "link_no", "link")
