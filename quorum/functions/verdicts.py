"""Strict reading of judges' texts: exactly one distinct verdict, or an error that names what is wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of the verdict lines.
PAIRWISE = r"(?i)VERDICT\s*:\s*(FIRST|SECOND|TIE)\b"
BINARY = r"(?i)VERDICT\s*:\s*(PASS|FAIL)\b"
SCALAR = r"SCORE\s*:\s*([+-]?\d+(?:\.\d+)?)"


def _only(found: Column) -> tuple[Column, Column]:
    error = F.when(F.size(found) == 0, "missing").when(F.size(found) > 1, "conflicting")
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))), error


def pairwise_verdict(text: Column, ties_allowed: bool = True) -> Column:
    """(verdict first, second or tie; error missing, conflicting or tie)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PAIRWISE), F.lit(1)), lambda x: F.lower(x)))
    verdict, error = _only(found)
    if not ties_allowed:
        error = F.coalesce(error, F.when(verdict == "tie", "tie"))
    return F.struct(F.when(error.isNull(), verdict).alias("verdict"), error.alias("error"))


def binary_verdict(text: Column) -> Column:
    """(verdict 1.0 or 0.0; error missing or conflicting)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BINARY), F.lit(1)), lambda x: F.lower(x)))
    verdict, error = _only(found)
    return F.struct(F.when(verdict == "pass", 1.0).when(verdict == "fail", 0.0).alias("verdict"), error.alias("error"))


def scalar_verdict(text: Column, low: float, high: float) -> Column:
    """(verdict; error missing, conflicting or scale): scores are compared as numbers and never clamped."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SCALAR), F.lit(1)), lambda x: x.cast("double")))
    verdict, error = _only(found)
    error = F.coalesce(error, F.when(~verdict.between(low, high), "scale"))
    return F.struct(F.when(error.isNull(), verdict).alias("verdict"), error.alias("error"))
