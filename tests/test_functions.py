"""Scalar functions against tables of examples and plain Python definitions."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import categories, geo, numbers, text, units


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def nfd(s):
    plain = "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"[^a-z0-9%,./+-]+", " ", plain.lower()).strip(" ")


def test_normalize_equals_nfd_definition(spark):
    points = [c for c in range(1, 0x3000) if not 0xD800 <= c <= 0xDFFF]
    inputs = [f"a{chr(c)}B" for c in points] + ["Roșii", "ÎNGHEȚATĂ  3,5% ", "şţ", ""]
    got = values(spark, inputs, text.normalize_text)
    assert got == [nfd(s) for s in inputs]
    assert values(spark, got, text.normalize_text) == got


def test_unit_sizes(spark):
    cases = {
        "1 L": (1.0, "l"), "500g": (0.5, "kg"), "6x1,5l": (9.0, "l"), "10 buc": (10.0, "buc"),
        "la bucata": (1.0, "buc"), "4 x 100 g": (0.4, "kg"), "2 bucăți": (2.0, "buc"),
        "10 ouă": (10.0, "buc"), "5 grame": None, "abc": None, None: None, "33 cl": (0.33, "l"),
        "buc": (1.0, "buc"), "pachet 0 g": (0.0, "kg"), "3 litri": (3.0, "l"),
    }
    got = values(spark, list(cases), units.parse_unit_size)
    assert [None if g is None else tuple(g) for g in got] == list(cases.values())


def test_base_price(spark):
    inputs = ["(=1 kg 37.98)", "(=100 g 3.80)", "1 kg 3", None]
    got = values(spark, inputs, units.parse_base_price)
    assert [None if g is None else tuple(g) for g in got] == [(37.98, "kg"), (38.0, "kg"), None, None]
    compat = values(spark, inputs, lambda c: units.parse_base_price(c, reference_compat=True))
    assert compat == [None] * 4


@pytest.mark.parametrize(
    "fn, cases",
    [
        (units.unit_from_name, {"Lapte Zuzu 1,5% 1 l": "1 l", "x": None, "Bere 6x330 ML": "6x330 ML"}),
        (text.title_case, {"ROSII": "Rosii", "MERE-PERE ȘI": "Mere-Pere Și", "Lapte": "Lapte"}),
        (text.capitalize_slug, {"mega-image": "Mega Image", "lidl": "Lidl"}),
        (text.alternative_stem, {"lapte zuzu": "lapt", "de la": None, "unt": "unt", "aabb bbaa": "aabb"}),
        (numbers.parse_price, {"6,49": 6.49, "6.49 lei": 6.49, "1,2,3": 1.2, "lei 3": None, "": None}),
        (geo.county_from_postal_code, {"40 00 10": "Cluj", "0123456": None, "990000": None}),
        (geo.county_from_city, {"Iași": "Iași", "CLUJ-NAPOCA": "Cluj", "Paris": None}),
        (lambda c: categories.map_category(None, c),
         {"Carton ondulat": "peste", "Lapte pentru pisici": "animale", "Biscuiți fără lapte": "dulciuri",
          "mic dejunuri": "altele", "mic dejun": "mic-dejun", "corn flakes": "mic-dejun", "": "altele",
          "Pet shop": "animale", "salate": "fructe-legume", "rufe": "menaj", "rufele": "altele"}),
        (text.strip_html, {"<b>A</b> &amp;  B": "A & B"}),
        (text.admin_product_id, {"Pâine  Albă": "admin-paine-alba"}),
    ],
)
def test_examples(spark, fn, cases):
    assert values(spark, list(cases), fn) == list(cases.values())


def test_category_prefilter_equals_regex(spark):
    words = [
        "animal", "xanimal", "hrana uscata", "hrana umedas", "copii", "copiii", "bacon", "baconul",
        "ton", "oua", "ouale", "flori", "cornflakes", "corn  flakes", "petshop", "salati", "sosuri", "sos",
    ]
    inputs = words + [f"ab {w} cd" for w in words] + [f"{a}-{b}" for a in words for b in words]

    def model(s):
        n = nfd(s)
        return next((c for p, c in categories.CATEGORY_RULES if re.search(p, n)), "altele")

    got = values(spark, inputs, lambda c: categories.map_category(None, c))
    assert got == [model(s) for s in inputs]


def test_rounding_and_sanity(spark):
    assert values(spark, [1.005, 8.995, 2.345], lambda c: numbers.round_half_up(c, 2), "double") == [
        1.0, 8.99, 2.35,
    ]
    sane = values(spark, [0.04, 0.05, 30000.0, 30001.0, float("nan")], numbers.is_sane_price, "double")
    assert sane == [False, True, True, False, False]


def test_names_and_labels(spark):
    df = spark.createDataFrame(
        [("Fanta Pere", "Fanta"), ("Lapte", "Zuzu"), ("Lapte", None), ("Lapte", "")],
        "name string, brand string",
    )
    rows = df.select(
        text.build_normalized_name(F.col("name"), F.col("brand")), text.display_label(F.col("name"), F.col("brand"))
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("fanta pere", "Fanta Pere"), ("zuzu lapte", "Zuzu Lapte"), ("lapte", "Lapte"), ("lapte", "Lapte"),
    ]


def test_texts_are_parsed_once(spark):
    odd = ["a b", " a  b ", "a \t b", "a_b", "a _b", "a_ b", " a ", "_", " ", "", None, "x - y", "ab\n"]
    plain = [None if s is None else nfd(s) for s in odd]
    assert values(spark, odd, text.normalize_text) == plain
    assert values(spark, odd, text.js_trim) == [None if s is None else s.strip(" \t\n  ") for s in odd]
    packs = ["2 x 1,5 l", "2x500 g", "12 role", "0,75 l", "3 x 2 buc", "bucata", "x 5 kg", "9" * 20 + " g", "set 6 oua"]
    got = [g and tuple(g) for g in values(spark, packs, units.parse_unit_size)]
    want = [(3.0, "l"), (1.0, "kg"), (12.0, "buc"), (0.75, "l"), (6.0, "buc"), (1.0, "buc"), (5.0, "kg")]
    assert got[:7] == want and got[8] == (6.0, "buc")
    df = spark.createDataFrame([(5.0, "2 kg")], "p double, u string")
    plan = df.select(units.price_per_unit(F.col("p"), units.parse_unit_size(F.col("u"))).alias("x"))
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count(units.MULTIPACK) == 1  # the pack was parsed for each field before
    assert tuple(plan.first()["x"]) == (2.5, "kg")
