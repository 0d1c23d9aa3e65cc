"""What counts as a recorded value. The predicates differ on purpose: each source of numbers has its own idea of absence.

Every function takes columns and returns a boolean column that is never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def present(value: Column) -> Column:
    """not blank, unknown or nan in any case."""
    return ~F.lower(_clean(value)).isin("", "unknown", "nan")


def prompt_present(value: Column) -> Column:
    """not blank, not exactly standard, not nan in any case; unknown counts as present."""
    text = _clean(value)
    return ~text.isin("", "standard") & (F.lower(text) != "nan")


def is_cot(flag: Column, template: Column) -> Column:
    """the record says that chain of thought was used."""
    prompt = F.lower(F.coalesce(template.cast("string"), F.lit("")))
    told = ~F.lower(F.trim(F.coalesce(flag.cast("string"), F.lit("none")))).isin("", "none", "false", "0", "nan")
    return told | prompt.contains("chain") | prompt.contains("cot")


def cot_recorded(flag: Column, template: Column) -> Column:
    """the record says whether chain of thought was used, yes or no."""
    return F.lower(_clean(flag)).isin("false", "0") | is_cot(flag, template)


def has(value: Column) -> Column:
    """not blank, unknown, none, nan or null in any case."""
    return ~F.lower(_clean(value)).isin("", "unknown", "none", "nan", "null")


def aggregate_present(value: Column) -> Column:
    """not null, empty or exactly unknown; no trimming, and 0 and false are present."""
    return value.isNotNull() & ~value.cast("string").isin("", "unknown")


def truthy_present(value: Column) -> Column:
    """present by truth: a zero is absent."""
    return F.coalesce(value.cast("double") != 0, F.lit(False))


def not_null(value: Column) -> Column:
    """present unless null: a zero is present."""
    return value.isNotNull()


def truthy(value: Column) -> Column:
    """true, 1, yes or y."""
    return F.lower(_clean(value)).isin("true", "1", "yes", "y")


def coverage_fields() -> dict[str, Column]:
    """Fields of the coverage table over a flat results frame."""
    return {
        "shots": present(F.col("shots")),
        "harness": present(F.col("eval_library")),
        "prompt_template": prompt_present(F.col("prompt_template")),
        "temperature": present(F.col("temperature")),
        "chain_of_thought": cot_recorded(F.col("chain_of_thought"), F.col("prompt_template")),
        "cot_true": is_cot(F.col("chain_of_thought"), F.col("prompt_template")),
    }
