"""Text keys, clock times and labels, as column expressions; only Unicode folding needs an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code points that are written for a dash.
DASHES = "‐‑‒–—―−⁃﹘﹣－"
RULE_LINE = "─"
#: A clock time, and the words that join two of them.
CLOCK = r"(?<!\d)([01]?\d|2[0-4])\s*[:.]\s*([0-5]\d)(?!\d)"
RANGE = r"(?i)(?<!\d)([01]?\d|2[0-4])\s*[:.]\s*([0-5]\d)\s*(?:uhr)?\s*(?:-|bis)\s*([01]?\d|2[0-4])\s*[:.]\s*([0-5]\d)(?!\d)"
#: Fixed values, first match wins: a number names its level; pairs and transformations come before single voltages.
LEVELS = [
    (r"netzebene\s*([1-7])\b|\bne\s*([1-7])\b|\bebene\s*([1-7])\b|\blevel\s*([1-7])\b", "NUM"),
    (r"\bh(ö|oe)s\s*/\s*hs\b|h(ö|oe)chst\w*[-\s]*/\s*hoch", "NE2"),
    (r"\bhs\s*/\s*ms\b|hoch\w*[-\s]*/\s*mittel", "NE4"),
    (r"\bms\s*/\s*ns\b|mittel\w*[-\s]*/\s*nieder", "NE6"),
    (r"umspannung\s+(in|auf|zur)\s+(die\s+)?hoch", "NE2"),
    (r"umspannung\s+(in|auf|zur)\s+(die\s+)?mittel", "NE4"),
    (r"umspannung\s+(in|auf|zur)\s+(die\s+)?nieder", "NE6"),
    (r"h(ö|oe)chstspannung|\bh(ö|oe)s\b", "NE1"),
    (r"hochspannung|\bhs\b", "NE3"),
    (r"mittelspannung|\bms\b", "NE5"),
    (r"niederspannung|\bns\b", "NE7"),
]
#: Fixed values, first match wins: words that name a season.
SEASON_WORDS = [
    (r"winter|januar|dezember|\bdez\b|\bdec\b|\bjan\b|\bfeb", "winter"),
    (r"fr(ü|ue)hling|fr(ü|ue)hjahr|spring|m(ä|ae)rz", "spring"),
    (r"sommer|summer|juni|jun", "summer"),
    (r"herbst|autumn|fall|september|sep", "autumn"),
]


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Lower case without accents."""
    import unicodedata

    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)))


def plain_key(text: Column) -> Column:
    """The matching key of text that is in NFKC form already: everything but that stays in the JVM."""
    t = F.lower(F.translate(text, DASHES, "-" * len(DASHES)))
    # Keys have to agree with those of earlier tables.
    for pattern, to in (
        (RULE_LINE, " "),
        (r"(?U)\buhr\b", " "),
        (r"(\d)\s*\.\s*(\d\d)(?!\d)", "$1:$2"),
        (r"\s*-\s*", "-"),
        (r"\s*:\s*", ":"),
        (r"(?<!\d)(\d):(\d\d)", "0$1:$2"),
        (r"(?U)\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def match_key(text: Column) -> Column:
    """Unicode folded, dashes unified, lower case, clock times padded, spaces squeezed."""
    return plain_key(nfkc(text))


def parse_time(text: Column) -> Column:
    """Minutes since midnight of one clock time, with or without Uhr; null for anything else, and for past 24:00."""
    t = F.trim(F.replace(F.trim(text), F.lit("Uhr"), F.lit("")))
    whole = "^" + CLOCK + "$"
    m = F.regexp_extract(t, whole, 1).try_cast("int") * 60 + F.regexp_extract(t, whole, 2).try_cast("int")
    return F.when(m <= 1440, m)


def times_in(text: Column) -> Column:
    """All clock times in order, in minutes; text in NFKC form."""
    hours, minutes = (F.regexp_extract_all(text, F.lit(CLOCK), F.lit(k)) for k in (1, 2))
    return F.filter(F.zip_with(hours, minutes, lambda h, m: h.cast("int") * 60 + m.cast("int")), lambda x: x <= 1440)


def time_ranges_in(text: Column) -> Column:
    """All ranges as structs (start, end) in minutes; text in NFKC form."""
    t = F.translate(text, DASHES, "-" * len(DASHES))
    part = [F.regexp_extract_all(t, F.lit(RANGE), F.lit(k)) for k in (1, 2, 3, 4)]
    minutes = [F.zip_with(part[k], part[k + 1], lambda h, m: h.cast("int") * 60 + m.cast("int")) for k in (0, 2)]
    return F.zip_with(*minutes, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def map_level(label: Column) -> Column:
    """NE1 to NE7 of a printed label, null if none fits; label in NFKC form."""
    t = F.replace(F.lower(label), F.lit("\n"), F.lit(" "))
    out = None
    for pattern, to in LEVELS:
        to = F.concat(F.lit("NE"), *[F.regexp_extract(t, pattern, k) for k in (1, 2, 3, 4)]) if to == "NUM" else F.lit(to)
        hit = t.rlike("(?U)" + pattern)
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return out


def map_season(label: Column) -> Column:
    t = F.lower(label)
    out = None
    for pattern, to in SEASON_WORDS:
        hit = t.rlike("(?U)" + pattern)
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return out


def normal_level(level: Column) -> Column:
    """5, ne 5 and NE5 are NE5."""
    t = F.replace(F.upper(level), F.lit(" "), F.lit(""))
    return F.when(t.startswith("NE"), t).otherwise(F.concat(F.lit("NE"), t))


def text_health(text: Column, has_images: Column) -> Column:
    """empty, garbled or ok: how far a page's text layer can be used."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.length(t)
    # Unreadable glyphs: replacement and private-use characters and what stands for unmapped ones.
    bad = F.regexp_count(t, F.lit(r"[�-]|\(cid:"))
    shown = n - F.regexp_count(t, F.lit(r"[\p{C}&&[^\n\r\t]]"))
    return F.when(n < 15, F.when(has_images | (n == 0), "empty").otherwise("ok")).when((bad > 0.05 * n) | (shown < 0.9 * n), "garbled").otherwise("ok")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def run_key(*parts: Column) -> Column:
    """Names a run by its inputs and versions; an unchanged key is not run again."""
    return F.left(content_hash(*parts), F.lit(16))


def person_id(name: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]", "-")
    return F.when(t == "", "reviewer").otherwise(t)


def json_object(answer: Column, schema: str) -> Column:
    """The object of a model's answer, inside a code fence or between the outermost braces."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(bare), schema)
