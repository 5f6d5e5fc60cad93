"""Counties from postal codes and cities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import blank_to_null, normalize_text

# First two digits of a postal code -> county.
POSTAL_PREFIX_COUNTY = {
    "01": "București", "02": "București", "03": "București", "04": "București",
    "05": "București", "06": "București", "07": "Ilfov", "08": "Giurgiu",
    "10": "Prahova", "11": "Argeș", "12": "Buzău", "13": "Dâmbovița", "14": "Teleorman",
    "20": "Dolj", "21": "Gorj", "22": "Mehedinți", "23": "Olt", "24": "Vâlcea",
    "30": "Timiș", "31": "Arad", "32": "Caraș-Severin", "33": "Hunedoara",
    "40": "Cluj", "41": "Bihor", "42": "Bistrița-Năsăud", "43": "Maramureș",
    "44": "Satu Mare", "45": "Sălaj",
    "50": "Brașov", "51": "Alba", "52": "Covasna", "53": "Harghita", "54": "Mureș", "55": "Sibiu",
    "60": "Bacău", "61": "Neamț", "62": "Vrancea",
    "70": "Iași", "71": "Botoșani", "72": "Suceava", "73": "Vaslui",
    "80": "Galați", "81": "Brăila", "82": "Tulcea",
    "90": "Constanța", "91": "Călărași", "92": "Ialomița",
}

# Normalised city -> county, used without a postal code.
CITY_COUNTY = {
    "bucuresti": "București",
    "alba iulia": "Alba",
    "arad": "Arad",
    "pitesti": "Argeș",
    "bacau": "Bacău",
    "oradea": "Bihor",
    "bistrita": "Bistrița-Năsăud",
    "botosani": "Botoșani",
    "brasov": "Brașov",
    "braila": "Brăila",
    "buzau": "Buzău",
    "resita": "Caraș-Severin",
    "calarasi": "Călărași",
    "cluj-napoca": "Cluj",
    "cluj napoca": "Cluj",
    "constanta": "Constanța",
    "mangalia": "Constanța",
    "sfantu gheorghe": "Covasna",
    "targoviste": "Dâmbovița",
    "craiova": "Dolj",
    "galati": "Galați",
    "giurgiu": "Giurgiu",
    "targu jiu": "Gorj",
    "miercurea ciuc": "Harghita",
    "deva": "Hunedoara",
    "hunedoara": "Hunedoara",
    "petrosani": "Hunedoara",
    "slobozia": "Ialomița",
    "iasi": "Iași",
    "voluntari": "Ilfov",
    "otopeni": "Ilfov",
    "baia mare": "Maramureș",
    "drobeta-turnu severin": "Mehedinți",
    "drobeta turnu severin": "Mehedinți",
    "targu mures": "Mureș",
    "piatra neamt": "Neamț",
    "roman": "Neamț",
    "slatina": "Olt",
    "ploiesti": "Prahova",
    "campina": "Prahova",
    "satu mare": "Satu Mare",
    "zalau": "Sălaj",
    "sibiu": "Sibiu",
    "medias": "Sibiu",
    "suceava": "Suceava",
    "alexandria": "Teleorman",
    "timisoara": "Timiș",
    "tulcea": "Tulcea",
    "vaslui": "Vaslui",
    "barlad": "Vaslui",
    "ramnicu valcea": "Vâlcea",
    "focsani": "Vrancea",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def county_from_postal_code(postal_code: Column) -> Column:
    digits = F.regexp_replace(postal_code, "[^0-9]", "")
    return F.when(
        F.length(digits) == 6, _lookup(POSTAL_PREFIX_COUNTY, F.substring(digits, 1, 2))
    )


def county_from_city(city: Column) -> Column:
    return _lookup(CITY_COUNTY, normalize_text(city))


def resolve_county(county: Column, postal_code: Column, city: Column) -> Column:
    """Explicit county, else from the postal code, else from the city."""
    return F.coalesce(
        blank_to_null(county), county_from_postal_code(postal_code), county_from_city(city)
    )
