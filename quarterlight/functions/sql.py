"""The functions by name, for queries written as SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .clock import ZONE
from .fuzzy import ratio, token_set_ratio
from .text import DASHES, RULE_LINE, nfkc

#: Name, parameters and result of each function, and its text in SQL.
DEFINITIONS = [
    (
        "quarter_hours",
        "year INT, zone STRING DEFAULT '" + ZONE + "'",
        "TABLE (start_utc TIMESTAMP_NTZ, start_local TIMESTAMP_NTZ, minute INT)",
        """SELECT s, convert_timezone('UTC', zone, s), CAST(hour(convert_timezone('UTC', zone, s)) * 60 + minute(convert_timezone('UTC', zone, s)) AS INT)
FROM (SELECT explode(sequence(convert_timezone(zone, 'UTC', make_timestamp_ntz(year, 1, 1, 0, 0, 0)), convert_timezone(zone, 'UTC', make_timestamp_ntz(year + 1, 1, 1, 0, 0, 0)) - INTERVAL 15 MINUTES, INTERVAL 15 MINUTES)) AS s)""",
    ),
    ("quarter_of", "ts TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "date_trunc('HOUR', ts) + make_dt_interval(0, 0, CAST(minute(ts) DIV 15 * 15 AS INT), 0)"),
    ("season_of", "day DATE", "STRING", "element_at(array('winter', 'spring', 'summer', 'autumn'), CAST(month(day) % 12 DIV 3 + 1 AS INT))"),
    ("hhmm", "minutes INT", "STRING", "concat(lpad(CAST(minutes DIV 60 AS STRING), 2, '0'), ':', lpad(CAST(minutes % 60 AS STRING), 2, '0'))"),
    (
        "plain_key",
        "text STRING",
        "STRING",
        "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(translate(text, '" + DASHES + "', '" + "-" * len(DASHES) + "')), '" + RULE_LINE + "', ' '), "
        r"r'(?U)\buhr\b', ' '), r'(\d)\s*\.\s*(\d\d)(?!\d)', '$1:$2'), r'\s*-\s*', '-'), r'\s*:\s*', ':'), r'(?<!\d)(\d):(\d\d)', '0$1:$2'), r'(?U)\s+', ' '))",
    ),
]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: quarter_hours (a table), quarter_of, season_of, hhmm, plain_key and match_key, which
    are expanded into the query's plan, and the Arrow functions nfkc, indel_ratio and token_set_ratio."""
    for name, parameters, result, body in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, f in (("nfkc", nfkc), ("indel_ratio", ratio), ("token_set_ratio", token_set_ratio)):
        spark.udf.register(name, f)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION match_key(text STRING) RETURNS STRING RETURN plain_key(nfkc(text))")
