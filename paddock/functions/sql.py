"""The parsers as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from paddock.functions import parse

_TIME = parse.KM_TIME.replace("\\", "\\\\")


def _time_part(i: int) -> str:
    return f"try_cast(nullif(regexp_extract(trim(t), '{_TIME}', {i}), '') AS INT)"


#: Name, parameter and body; the bodies are expressions, so Catalyst inlines and optimises them.
FUNCTIONS = {
    "km_time_code": ("t STRING", "INT", f"coalesce({_time_part(1)}, 1) * 1000 + {_time_part(2)} * 10 + {_time_part(3)}"),
    "money_kr": ("t STRING", "BIGINT", r"try_cast(nullif(regexp_replace(regexp_extract(replace(replace(t, '\u00a0', ' '), '.', ' '), '[\\d\\s]+', 0), '\\s', ''), '') AS BIGINT)"),
    "distance_band": ("m INT", "STRING", "CASE WHEN m IS NULL THEN NULL WHEN m <= 1700 THEN 's' WHEN m <= 2250 THEN 'm' ELSE 'l' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql``; ``normalize_name`` comes with them."""
    for name, (arg, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arg}) RETURNS {kind} RETURN {body}")
    two = "regexp_replace(t, '\\\\p{Mn}', '')"
    for a, b in parse.DOUBLED:
        two = f"replace({two}, '{a}', '{b}')"
    suffix = parse.NAME_SUFFIX.replace("\\", "\\\\")
    bare = f"regexp_replace(translate({two}, '{parse.MARKED}', '{parse.PLAIN}'), '{suffix}', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_name(t STRING) RETURNS STRING RETURN coalesce(regexp_replace(upper(trim({bare})), '\\\\s+', ' '), '')")
    return [*FUNCTIONS, "normalize_name"]
