"""Column functions for raw feed text: ids, names, packed pairs, dates, seasons, flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kickframe.functions.cols import clamp, col

# Accent folding, tokens that mean "missing", club prefixes ignored in loose matching,
# words for yes and no.
ACCENTED = "áàâäãåăąçćčďéèêëěęíìîïñńňóòôöõőřśšşșťţțúùûüůűýÿžźżÁÀÂÄÃÅĂĄÇĆČĎÉÈÊËĚĘÍÌÎÏÑŃŇÓÒÔÖÕŐŘŚŠŞȘŤŢȚÚÙÛÜŮŰÝŽŹŻ"
PLAIN = "aaaaaaaacccdeeeeeeiiiinnnoooooorsssstttuuuuuuyyzzzAAAAAAAACCCDEEEEEEIIIINNNOOOOOORSSSSTTTUUUUUUYZZZ"
MISSING_TOKENS = ["", "nan", "none", "null"]
LOOSE_PREFIXES = ["fc", "sc", "sv", "vfl", "vfb", "tsg", "fcv", "1fc"]
YES_WORDS = ["1", "true", "t", "yes", "y"]
NO_WORDS = ["0", "false", "f", "no", "n", "none", "", "nan"]
MATCH_TYPE_WORDS = [
    ("friendly", "friend|amical"),
    ("playoff", "playoff|play-off|promotion|relegation"),
    ("cup", "cup|copa|coupe|pokal|cupa"),
    ("league", "league|liga|division"),
]


def clean_id(c: Column | str) -> Column:
    """Trimmed id without a trailing ``.0``; tokens for missing become null."""
    s = F.trim(col(c).cast("string"))
    return F.when(~F.lower(s).isin(MISSING_TOKENS), F.regexp_replace(s, r"^(\d+)\.0$", "$1"))


def fold_name(c: Column | str, loose: bool = False) -> Column:
    """Accents stripped, lower case, punctuation to single blanks; loose drops leading club tokens."""
    s = F.regexp_replace(F.translate(col(c), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")  # what does not fold is dropped
    s = F.lower(s)
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    if loose:
        s = F.regexp_replace(s, rf"^(?:(?:\d+|{'|'.join(LOOSE_PREFIXES)})(?:\s+|$))+", "")
    return s


def to_number(c: Column | str) -> Column:
    """Double from text with a decimal comma or a percent sign; null when unparseable."""
    return _number(col(c))


def _number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), ",", "."), "%$", "").try_cast("double")


def split_pair(c: Column | str) -> tuple[Column, Column]:
    """``H-A`` text to two doubles."""
    parts = F.split(F.trim(col(c)), r"\s*-\s*", 2)
    return _number(F.get(parts, 0)), _number(F.get(parts, 1))


def minutes_list(c: Column | str) -> Column:
    """Goal minutes from a list such as ``37,H49 45+2``; stoppage time counts to its base minute."""
    tokens = F.split(F.trim(col(c)), r"[,\s;]+")
    base = F.transform(tokens, lambda x: F.regexp_extract(x, r"^[HA]*\s*(\d+)(?:\+.*)?$", 1).try_cast("int"))
    return F.coalesce(F.filter(base, lambda m: m.isNotNull() & m.between(0, 130)), F.array().cast("array<int>"))


def clock_to_hhmm(c: Column | str) -> Column:
    """``19:05``, ``1905`` or ``1905.0`` to the integer 1905."""
    s = F.trim(col(c).cast("string"))
    h, m = F.regexp_extract(s, r"^(\d{1,2}):(\d{2})", 1), F.regexp_extract(s, r"^(\d{1,2}):(\d{2})", 2)
    colon = F.concat(h, m).try_cast("int")
    return F.when(s.rlike(r"^\d{1,2}:\d{2}"), colon).otherwise(s.try_cast("double").cast("int"))


def kickoff_from_parts(day: Column | str, hhmm: Column | str) -> Column:
    """Date plus an HHMM integer, hour and minute clamped; a missing time means midnight."""
    t = F.coalesce(col(hhmm).cast("int"), F.lit(0))
    hour, minute = clamp(F.floor(t / 100), 0, 23), clamp(t % 100, 0, 59)
    return col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=hour.cast("int"), mins=minute.cast("int"))


def iso_utc(c: Column | str) -> Column:
    """ISO text with offset or Z to a UTC wall-clock timestamp; null when unparseable."""
    s = F.regexp_replace(F.trim(col(c)), "Z$", "+00:00")
    return F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")).cast("timestamp_ntz")


def season_label(c: Column | str) -> Column:
    """``24`` or ``2024`` or ``2024.0`` to ``2024-2025``; labels with a dash stay."""
    s = F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", "")
    full = F.when(s.rlike(r"^\d{2}$"), F.lit(2000) + s.try_cast("int")).when(s.rlike(r"^\d{4}$"), s.try_cast("int"))
    return (
        F.when(F.lower(s).isin(MISSING_TOKENS), None)
        .when(full.isNotNull(), F.concat_ws("-", full.cast("string"), (full + 1).cast("string")))
        .otherwise(s)
    )


def season_of(day: Column | str) -> Column:
    """Season label of a date; seasons start in August."""
    d = col(day)
    y = F.year(d) - (F.month(d) < 8).cast("int")
    return F.concat_ws("-", y.cast("string"), (y + 1).cast("string"))


def truthy(c: Column | str) -> Column:
    """Text to 0/1."""
    s = F.lower(F.trim(col(c).cast("string")))
    n = s.try_cast("double")
    return F.when(s.isin(YES_WORDS), 1).when(s.isin(NO_WORDS) | n.isNull(), 0).otherwise((n != 0).cast("int"))


def match_type(labels: list[str], league: str = "league") -> Column:
    """Kind of match from the first non-blank label column, else from the league name."""
    first = F.coalesce(*[F.nullif(F.lower(F.trim(F.col(x))), F.lit("")) for x in labels])
    out = F.when(F.lit(False), "")
    for kind, words in MATCH_TYPE_WORDS:
        out = out.when(first.rlike(words), kind)
    lg = F.lower(F.trim(F.col(league)))
    by_league = (
        F.when(lg.rlike(dict(MATCH_TYPE_WORDS)["cup"]), "cup")
        .when(F.coalesce(lg, F.lit("")) != "", "league")
        .otherwise("unknown")
    )
    return F.when(first.isNotNull(), F.coalesce(out, F.lit("unknown"))).otherwise(by_league)


def from_map(key: Column, values: Mapping[str, object], default: object = None) -> Column:
    """Lookup in a small fixed map."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)
    return F.coalesce(found, F.lit(default)) if default is not None else found
