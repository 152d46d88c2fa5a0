"""The scalar functions as SQL functions of a session. They are SQL themselves, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyforge.functions.scalars import AMOUNT_TOKEN, SECRET, SUMMARY_ROW


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


FUNCTIONS = {
    "tf_to_number(s STRING) RETURNS DOUBLE": r"try_cast(regexp_replace(s, '[^0-9.\\-]', '') AS DOUBLE)",
    "tf_to_unsigned(s STRING) RETURNS DOUBLE": r"try_cast(regexp_replace(s, '[^\\d.]', '') AS DOUBLE)",
    "tf_amounts(s STRING) RETURNS ARRAY<DOUBLE>": r"transform(regexp_extract_all(s, '\\d[\\d,]*\\.\\d{2}', 0), m -> cast(replace(m, ',', '') AS DOUBLE))",
    "tf_last_figure(s STRING) RETURNS STRING": r"replace(try_element_at(regexp_extract_all(s, '[\\d,]+\\.?\\d*', 0), -1), ',', '')",
    "tf_clean_text(s STRING) RETURNS STRING": r"regexp_replace(replace(s, '\u0000', '-'), '[\\x00-\\x08\\x0A-\\x1F]', '')",
    "tf_norm_label(s STRING) RETURNS STRING": "btrim(lower(s), ':.,;-()[]% ')",
    "tf_is_amount(s STRING) RETURNS BOOLEAN": f"rlike(trim(s), {_q(AMOUNT_TOKEN)})",
    "tf_scrub(s STRING) RETURNS STRING": f"substring(regexp_replace(s, {_q(SECRET)}, '[REDACTED]'), 1, 500)",
    "tf_strip_doubt(s STRING) RETURNS STRING": r"trim(regexp_replace(s, '\\[?\\?+([^?\\]]*)\\?+\\]?', '$1'))",
    "tf_slugify(s STRING) RETURNS STRING": "btrim(regexp_replace(lower(trim(s)), '[^a-z0-9]+', '_'), '_')",
    "tf_is_summary_row(s STRING) RETURNS BOOLEAN": f"rlike(lower(trim(coalesce(s, ''))), {_q(SUMMARY_ROW)}) OR lower(trim(coalesce(s, ''))) IN ('', '-', 'n/a', 'none')",
    "tf_duplicate_key(v STRING, n STRING) RETURNS STRING": "CASE WHEN replace(trim(coalesce(n, '')), ' ', '') = '' THEN '' ELSE lower(trim(coalesce(v, ''))) || '|' || replace(lower(trim(n)), ' ', '') END",
    "tf_mask_key(s STRING) RETURNS STRING": "CASE WHEN s IS NULL OR s = '' THEN '(none)' WHEN length(s) > 10 THEN left(s, 3) || '…' || right(s, 3) ELSE '…' END",
    "tf_file_hash(b BINARY) RETURNS STRING": "substring(sha2(b, 256), 1, 16)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
