"""Language and region of a search: region codes and the header of accepted languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The country of a language where its code is another, then codes that engines spell otherwise.
COUNTRIES = {"en": "us", "pt": "br", "ja": "jp", "zh": "cn", "ko": "kr", "sv": "se", "da": "dk", "cs": "cz", "el": "gr", "uk": "ua", "ar": "xa", "he": "il", "hi": "in"}
ALIASES = {"gb": "uk", "en": "us"}


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key], key)


def _language(lang: Column) -> Column:
    return F.coalesce(F.nullif(lang, F.lit("")), F.lit("en"))


def base_language(lang: Column) -> Column:
    return F.lower(F.get(F.split(_language(lang), "-"), F.lit(0)))


def region_of(lang: Column, region: Column) -> Column:
    """The region given, else that of the language tag, else the language's country."""
    tagged = F.nullif(F.get(F.split(_language(lang), "-"), F.lit(1)), F.lit(""))
    return F.lower(F.coalesce(F.nullif(F.trim(region), F.lit("")), tagged, _mapped(COUNTRIES, base_language(lang))))


def engine_region(lang: Column, region: Column) -> Column:
    return F.concat_ws("-", _mapped(ALIASES, region_of(lang, region)), base_language(lang))


def accept_language(lang: Column, region: Column) -> Column:
    own = base_language(lang)
    head = F.concat(own, F.lit("-"), F.upper(region_of(lang, region)), F.lit(","), own, F.lit(";q=0.9"))
    return F.when(own == "en", head).otherwise(F.concat(head, F.lit(",en;q=0.5")))
