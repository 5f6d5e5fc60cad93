"""Canonical categories and keyword rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import bind, normalize_text

# Category slug -> label.
CATEGORIES = {
    "fructe-legume": "Fructe și legume",
    "lactate-oua": "Lactate și ouă",
    "carne-mezeluri": "Carne și mezeluri",
    "peste": "Pește",
    "panificatie": "Panificație",
    "alimente-baza": "Alimente de bază",
    "conserve": "Conserve",
    "dulciuri": "Dulciuri și snacks",
    "mic-dejun": "Mic dejun și cereale",
    "bauturi": "Băuturi",
    "congelate": "Congelate și înghețată",
    "menaj": "Menaj și curățenie",
    "ingrijire-personala": "Îngrijire personală",
    "bebe-copii": "Bebeluși și copii",
    "animale": "Animale de companie",
    "altele": "Altele",
}
FALLBACK = "altele"

# Keyword patterns on normalised text, in order; the first match wins.
# The word boundaries bind to the first and last alternative only.
CATEGORY_RULES = [
    (r"\banimal|caine|caini|catel|pisic|pet ?shop|hrana (uscata|umeda|pentru)\b", "animale"),
    (r"\bbebe|scutece|formule lapte|lapte praf|copii\b", "bebe-copii"),
    (r"\bmezel|salam|carnati|sunca|crenvur|parizer|kaizer|bacon\b", "carne-mezeluri"),
    (r"\bcarne|pui|porc|vita|curcan|miel|grill\b", "carne-mezeluri"),
    (r"\bpeste|somon|ton|hering|fructe de mare|creveti\b", "peste"),
    (r"\bdulciuri|ciocolat|biscuit|napolitan|bomboane|snack|chips|sticksuri|pufuleti|prajitur\b", "dulciuri"),
    (r"\blactate|lapte|iaurt|branz|cascaval|smantana|unt|kefir|sana|telemea|mozzarella|oua\b", "lactate-oua"),
    (r"\blegume|fructe|salat[ae]|verdeturi|flori\b", "fructe-legume"),
    (r"\bpaine|panificatie|patiserie|covrig|bagheta|chifl|lipie|cozonac\b", "panificatie"),
    (r"\bcereale|musli|corn ?flakes|gem|miere|dulceata|crema de ciocolata|mic dejun\b", "mic-dejun"),
    (r"\bconserv|muraturi|zacusca|compot\b", "conserve"),
    (r"\bbautur|suc|apa|bere|vin|cafea|ceai|energizant|cola|limonada|whisky|vodca\b", "bauturi"),
    (r"\bcongelat|inghetata|frozen\b", "congelate"),
    (r"\bulei|faina|zahar|orez|paste|malai|otet|condiment|sare|mustar|ketchup|maionez|sos\b", "alimente-baza"),
    (r"\bdetergent|curatenie|menaj|hartie igienica|servetele|prosop|vase|rufe\b", "menaj"),
    (r"\bsampon|gel de dus|sapun|pasta de dinti|deodorant|cosmetic|ingrijire\b", "ingrijire-personala"),
]


def _literal_cores(pattern: str) -> list[str]:
    """For each alternative of a rule, a plain text that any match contains."""
    alternatives = re.split(r"\|(?![^(]*\))", pattern)
    return [
        max(re.split(r"\\b|.\?|\(.*?\)|\[.*?\]", a), key=len) for a in alternatives
    ]


def _matches(normalized: Column, pattern: str) -> Column:
    """``rlike``, tried only on texts that hold one of the rule's plain texts.

    Substring tests are many times cheaper than a regex scan and reject most texts.
    """
    possible = None
    for core in _literal_cores(pattern):
        hit = F.contains(normalized, F.lit(core))
        possible = hit if possible is None else possible | hit
    return F.when(possible, F.rlike(normalized, F.lit(pattern))).otherwise(F.lit(False))


def _by_rule(normalized: Column) -> Column:
    out = None
    for pattern, slug in CATEGORY_RULES:
        hit = _matches(normalized, pattern)
        out = F.when(hit, F.lit(slug)) if out is None else out.when(hit, F.lit(slug))
    return out


def category_of_normalized(raw_norm: Column | None, name_norm: Column) -> Column:
    parts = [] if raw_norm is None else [bind(raw_norm, _by_rule)]
    return F.coalesce(*parts, bind(name_norm, _by_rule), F.lit(FALLBACK))


def map_category(raw: Column | None, name: Column) -> Column:
    """Canonical category from the shop's own category, else from the product name."""
    return category_of_normalized(
        None if raw is None else normalize_text(raw), normalize_text(name)
    )
