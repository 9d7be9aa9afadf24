"""Recognition of missing values, numbers and two-valued answers in raw study strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings read as missing.
NA_TOKENS = ("", "N", "A", "NA")
# Answers that are present but say nothing (compared in lower case).
UNKNOWN_TOKENS = ("uncertain", "unknown")
# Answers that make a feature two-valued (compared in lower case).
BOOLEAN_TOKENS = (
    "yes", "no", "1", "0", "1.0", "0.0", "present", "absent", "male", "female",
    "true", "t", "false", "f",
)
# Fixed pattern: what counts as a number. A bare cast also takes '1d', which is not one here.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)\s*$"


def is_missing(raw: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    return raw.isNull() | raw.isin(list(tokens))


def is_unknown(raw: Column) -> Column:
    return F.lower(raw).isin(list(UNKNOWN_TOKENS))


def is_boolean_token(raw: Column) -> Column:
    return F.lower(raw).isin(list(BOOLEAN_TOKENS))


def to_number(raw: Column) -> Column:
    """Double value of a number string, null for anything else."""
    return F.when(raw.rlike(NUMBER_PATTERN), F.trim(raw).try_cast("double"))
