"""From raw answers to typed claims: the meter's convention checked against the pages, rule values, windows and empty cells.

Conventions are settled by one join of readings with their own pages and one aggregate; everything else is a projection.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import QUARTER, hhmm
from ..functions.text import map_level, map_season, match_key, nfkc, parse_time, plain_key
from . import quality

#: Fixed values, on matching keys: what a time stamp stands for, listed times that are time stamps, and what follows a
#: listed start, before the first time stamp and after it, where a window is mapped to time stamps.
DEFINITION = r"zeitstempel (\d\d:\d\d) (?:definiert|bezeichnet|entspricht|steht f[üu]r|umfasst) (?:den |die |das )?(?:zeitraum|viertelstunde|intervall|messperiode) (?:von )?(\d\d:\d\d)(?: bis |-)(\d\d:\d\d)"
LISTED = r"(?:angegebenen|aufgef[üu]hrten|genannten|dargestellten|ver[öo]ffentlichten) (?:zeiten|viertelstunden|uhrzeiten|zeitpunkte) sind (?:die )?zeitstempel"
UNTIL = r"(?: bis |-)\d\d:\d\d"
STAMPS = r".{0,80}?zeitstempel\w* (?:von )?"
#: What may be said of bridge days; the first two can be turned into dates.
BRIDGE = ("working_day", "off_peak", "off_peak_max_one", "off_peak_max_one_per_week")
NUMBERS = ("significance_threshold", "min_kw_diff", "de_minimis_eur")
READING = ("document_id", "meter_label", "listed_start", "first_timestamp", "page", "quote")
_BREAK = "\x1f"


class Claims(NamedTuple):
    conventions: DataFrame
    windows: DataFrame
    empties: DataFrame
    rules: DataFrame
    findings: DataFrame


def map_convention(meter_label: Column, listed_start: Column, first_timestamp: Column) -> Column:
    """What a meter's label means, by the worked example where it is the interval's end."""
    shift = parse_time(first_timestamp) - parse_time(listed_start)
    ends = F.when(shift == QUARTER, "interval_end_physical").when(shift == 0, "interval_end_labels").otherwise("interval_end_ambiguous")
    return F.when(meter_label == "start", "interval_start").when(meter_label == "end", ends).otherwise("assumed")


def sentence(text: Column, fragment: Column) -> Column:
    """The first sentence, as printed, whose matching key holds the fragment; else the fragment."""
    parts = F.split(F.translate(text, _BREAK, " "), r"(?U)(?<=[.!?])\s+(?=[A-ZÄÖÜ])")
    keys = F.split(nfkc(F.array_join(parts, _BREAK)), _BREAK)
    both = F.zip_with(parts, keys, lambda s, k: F.when(F.contains(plain_key(k), fragment), s))
    return F.trim(F.regexp_replace(F.coalesce(F.get(F.filter(both, lambda s: s.isNotNull()), F.lit(0)), fragment), r"(?U)\s+", " "))


def resolve_conventions(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """Each reading's convention, page and quote, checked against its document's pages, and what it was read as.

    readings: document_id, meter_label, listed_start, first_timestamp, page, quote (equal rows count once); pages:
    document_id, page, text. A reading that rests on an example stands if some page maps a window from the listed
    start to time stamps from the first one. Else, or where nothing was read, the first page (the reading's own, then in
    order) that defines a time stamp as the quarter-hour it ends decides, if it says too that the listed times
    are time stamps. A document without pages, and a null text, says nothing.
    """
    r = readings.select(*READING).distinct().withColumn("was", map_convention(F.col("meter_label"), F.col("listed_start"), F.col("first_timestamp")))
    part = lambda k: F.regexp_extract("_key", DEFINITION, k)
    end = parse_time(part(1))
    defines = (end == parse_time(part(3))) & (end == F.coalesce(parse_time(part(2)), F.lit(0)) + QUARTER)
    keyed = pages.select("document_id", F.col("page").alias("_page"), F.col("text").alias("_text"), match_key("text").alias("_key"))
    keyed = keyed.where("_key LIKE '%zeitstempel%'").withColumns({"_defines": F.coalesce(defines, F.lit(False)), "_said": part(0), "_listed": F.regexp_extract("_key", LISTED, 0)})
    keyed = keyed.withColumn("_quote", F.when(F.col("_defines") & (F.col("_listed") != ""), F.concat_ws(" ", sentence(F.col("_text"), F.col("_listed")), sentence(F.col("_text"), F.col("_said")))))
    example = F.concat(hhmm(parse_time(F.col("listed_start"))), F.lit(UNTIL + STAMPS), hhmm(parse_time(F.col("first_timestamp"))), F.lit(UNTIL))
    rests = F.col("was").isin("interval_end_physical", "interval_end_labels")
    met = r.join(keyed, "document_id", "left").withColumn("_maps", F.when(rests & F.col("_key").isNotNull(), F.regexp_like("_key", F.concat(F.lit("(?U)"), example))))
    first = F.min(F.when(F.col("_defines"), F.struct((~F.col("_page").eqNullSafe(F.col("page"))).alias("other"), F.col("_page"), F.col("_quote")))).alias("_first")
    seen = met.groupBy(*READING, "was").agg(F.coalesce(F.bool_or("_maps"), F.lit(False)).alias("_maps"), first)
    told = F.col("_first._quote").isNotNull()
    now = (
        F.when(rests & F.col("_maps"), F.col("was"))
        .when(told & (F.col("was") != "interval_start"), "interval_end_labels")
        .when(rests, "interval_end_ambiguous")
        .otherwise(F.col("was"))
    )
    changed = F.col("convention") != F.col("was")
    seen = seen.withColumn("convention", now)
    new = {"severity": F.when(changed, F.when(rests, "warning").otherwise("info")), "page": F.when(changed & told, F.col("_first._page")).otherwise(F.col("page")), "quote": F.when(changed & told, F.col("_first._quote")).otherwise(F.col("quote"))}
    return seen.withColumns(new).select("document_id", "was", "convention", "page", "quote", "severity")


def convention_findings(resolved: DataFrame) -> DataFrame:
    """CONVENTION_CORRECTED: a warning where the reading's example is none, a notice where nothing had been read."""
    t = F.col("document_id").cast("string")
    return resolved.where("severity IS NOT NULL").select("document_id", F.lit("CONVENTION_CORRECTED").alias("code"), "severity", F.lit("extract").alias("stage"), t.alias("target"), F.concat_ws(" -> ", "was", "convention").alias("message"))


def rule_value(kind: Column, value: Column) -> Column:
    """A rule's value (JSON text) as a struct: value (JSON text in its usual form), resolved, problem.

    The text is read as a VARIANT, whose own type says what it is: a text, a number, a truth value, an object or a list. Null
    stands for JSON's null; broken JSON is no value, and a problem for every kind that needs one. Kinds that have no rule here keep their
    value and are resolved.
    """
    text = F.trim(F.coalesce(value, F.lit("null")))
    v = F.try_parse_json(text)
    type_ = F.coalesce(F.schema_of_variant(v), F.lit("BROKEN"))
    is_text, is_object = type_ == "STRING", type_.startswith("OBJECT")
    is_number = type_.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    said = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    bare = F.when(is_text, said).otherwise(text)
    # What counts as no value: null, false, zero, and an empty text, list or object.
    empty = (type_ == "VOID") | (type_ == "BOOLEAN") & ~F.try_variant_get(v, "$", "boolean") | is_number & (number == 0) | is_text & (said == "") | type_.isin("ARRAY<VOID>", "OBJECT<>") & text.rlike(r"^(\[\s*\]|\{\s*\})$")
    empty = F.coalesce(empty, F.lit(False))
    told = lambda value, resolved, problem=None: F.struct(value.alias("value"), F.coalesce(resolved, F.lit(False)).alias("resolved"), (F.lit(None).cast("string") if problem is None else problem).alias("problem"))
    unread = told(text, F.lit(False), F.concat(F.lit("cannot read value "), text))
    readable = empty | is_object

    field = lambda path, type_: F.when(is_object, F.try_variant_get(v, path, type_))
    none = F.array().cast("array<string>")
    states, mode = F.transform(F.coalesce(field("$.states", "array<string>"), none), F.upper), F.coalesce(field("$.mode", "string"), F.lit("unspecified"))
    dated = (F.size(states) == 1) | ((F.size(states) > 0) & mode.isin("union", "intersection"))
    holidays = told(F.to_json(F.struct(states.alias("states"), mode.alias("mode"), F.coalesce(field("$.exclude", "array<string>"), none).alias("exclude"))), dated)
    start, end = field("$.from", "string"), field("$.to", "string")
    christmas = told(F.to_json(F.struct(start.alias("from"), end.alias("to")), {"ignoreNullFields": "false"}), (F.length(start) > 0) & (F.length(end) > 0))
    plain = F.when(is_text, F.trim(F.replace(F.regexp_replace(said, "[%€]", ""), F.lit(","), F.lit("."))).try_cast("double")).when(is_number, number)
    bridge = F.when(bare.isin(*BRIDGE), told(bare, bare.isin(*BRIDGE[:2]))).otherwise(told(bare, F.lit(False), F.concat(F.lit("unknown bridge_days value "), bare)))
    return (
        F.when(kind == "workdays_only", told(F.when(empty & (type_ != "VOID"), "false").otherwise("true"), F.lit(True)))
        .when(kind == "bridge_days", bridge)
        .when((kind == "holiday_handling") & readable, holidays)
        .when((kind == "christmas_period") & readable, christmas)
        .when(kind.isin(*NUMBERS) & plain.isNotNull(), told(plain.cast("string"), F.lit(True)))
        .when(kind.isin("holiday_handling", "christmas_period", *NUMBERS), unread)
        .otherwise(told(text, F.lit(True)))
    )


def normalize(readings: DataFrame, windows: DataFrame, empties: DataFrame, rules: DataFrame, pages: DataFrame) -> Claims:
    """Raw answers as claims, and findings on what has no meaning.

    windows: document_id, level_label, season_label, start, end; empties: document_id, level_label, season_label; rules:
    document_id, kind, value, grounded; readings and pages as resolve_conventions has them. Further columns stay. Windows
    and empty cells whose labels or times have no meaning are left out and found; rules all stay, with value, resolved and problem.
    """
    labels = {"level": map_level(nfkc("level_label")), "season": map_season(nfkc("season_label"))}
    raw = windows.withColumns({**labels, "start_min": parse_time(F.col("start")), "end_min": parse_time(F.col("end"))})
    blank = empties.withColumns(labels)
    typed = rules.withColumn("_told", rule_value(F.col("kind"), F.col("value"))).withColumn("value", F.col("_told.value")).withColumns({n: F.col(f"_told.{n}") for n in ("resolved", "problem")}).drop("_told")
    conventions = resolve_conventions(readings, pages)
    found = quality.union([quality.label_findings(raw), quality.empty_cell_findings(blank), quality.rule_findings(typed), convention_findings(conventions)])
    whole = "level IS NOT NULL AND season IS NOT NULL"
    return Claims(conventions, raw.where(f"{whole} AND start_min IS NOT NULL AND end_min IS NOT NULL"), blank.where(whole), typed, found)
