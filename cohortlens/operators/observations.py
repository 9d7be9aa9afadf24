"""Feature families, missing values and per-feature summaries of a long study table.

Input is `observations(feature, sample_id, raw)`; `sample_id` orders the values of a feature.
Every summary is one partially aggregated pass, so a feature holding a large share of all rows
costs no more than its rows: only one buffer per feature and task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.tokens import (
    is_boolean_token, is_missing, is_unknown, to_number,
)
from cohortlens.session import lookup_side

FAMILIES = ("Binary", "Numerical", "Categorical", "Other")

# Flags of a value. Families follow from the smallest ids under conditions on them: bigint minima
# stay a hash aggregate (a minimum over strings or structs would sort all rows first).
_NUMBER, _ZERO_ONE, _UNKNOWN, _BOOLEAN = 1, 2, 4, 8


def drop_missing(obs: DataFrame) -> DataFrame:
    return obs.where(~is_missing(F.col("raw")))


def finite_only(values: DataFrame) -> DataFrame:
    """(.., value) rows that statistics are taken over: null, NaN and infinite values count as
    missing everywhere, so a feature keeps its other values."""
    return values.where(F.abs("value") < float("inf"))  # NaN is larger than any number


def non_finite_counts(values: DataFrame) -> DataFrame:
    """(feature, n_non_finite): the values that `finite_only` leaves out, null ones not counted."""
    left_out = F.col("value").isNotNull() & ~(F.abs("value") < float("inf"))
    return values.groupBy("feature").agg(F.count_if(left_out).alias("n_non_finite"))


def _flags(raw: Column, number: Column) -> Column:
    def bit(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    return (
        bit(number.isNotNull(), _NUMBER) + bit(number.isin(0.0, 1.0), _ZERO_ONE)
        + bit(is_unknown(raw), _UNKNOWN) + bit(is_boolean_token(raw), _BOOLEAN)
    )


def _has(code: Column, flag: int) -> Column:
    return code.bitwiseAND(F.lit(flag)) != 0


def feature_families(obs: DataFrame) -> DataFrame:
    """One row per feature: (feature, n_total, n_valid, n_na, n_numbers, family)."""
    raw = F.col("raw")
    missing = is_missing(raw)
    flagged = (
        obs.select("feature", "sample_id", "raw", missing.alias("missing"),
                   to_number(raw).alias("number"))
        .select(
            "feature", "sample_id", "missing",
            F.when(~F.col("missing"), _flags(raw, F.col("number"))).alias("flags"),
            F.when(~F.col("missing"), F.lower(raw)).alias("lowered"),
        )
    )
    flags = F.col("flags")
    position = F.col("sample_id")
    # two independent hashes stand in for "at least two distinct values"
    first_hash, second_hash = F.xxhash64("lowered"), F.hash("lowered")
    present = flags.isNotNull()

    summary = flagged.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(flags).alias("n_valid"),
        F.count_if(_has(flags, _NUMBER)).alias("n_numbers"),
        (F.min(F.when(present, first_hash)) != F.max(F.when(present, first_hash)))
        .alias("differs_1"),
        (F.min(F.when(present, second_hash)) != F.max(F.when(present, second_hash)))
        .alias("differs_2"),
        # the smallest id under each condition; a flag holds for the first value of some kind where
        # the smallest id with the flag is the smallest of the kind
        F.min(F.when(present, position)).alias("first_value"),
        F.min(F.when(_has(flags, _UNKNOWN), position)).alias("first_unknown"),
        F.min(F.when(~_has(flags, _UNKNOWN), position)).alias("first_known"),
        *[F.min(F.when(~_has(flags, _UNKNOWN) & _has(flags, flag), position)).alias(f"known_{name}")
          for name, flag in (("number", _NUMBER), ("boolean", _BOOLEAN), ("zero_one", _ZERO_ONE))],
        F.min(F.when(~_has(flags, _ZERO_ONE), position)).alias("first_not_01"),
        F.min(F.when(~_has(flags, _ZERO_ONE) & _has(flags, _NUMBER), position)).alias("not_01_number"),
    )

    # Second unknown answer of a feature: the ranking limit is applied before the shuffle.
    unknowns = obs.where(is_unknown(raw)).select("feature", "sample_id")
    order = Window.partitionBy("feature").orderBy("sample_id")
    second_unknown = (
        unknowns.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2)
        .groupBy("feature").agg(F.max(F.when(F.col("nth") == 2, F.col("sample_id")))
                                .alias("second_unknown"))
    )
    known, not_01 = F.col("first_known"), F.col("first_not_01")
    # The deciding value is the first one, or the second when the first is unknown.
    blocked = (
        F.col("first_value").eqNullSafe(F.col("first_unknown")) & F.col("second_unknown").isNotNull()
        & (F.col("second_unknown") < known)
    )
    by_token = F.when(F.col("known_boolean").eqNullSafe(known), F.lit("Binary")).otherwise(
        F.lit("Categorical"))
    family = (
        F.when((F.col("n_valid") < 4) | ~(F.col("differs_1") | F.col("differs_2")), "Other")
        .when(known.isNull(), "Other")
        .when(blocked | ~F.col("known_number").eqNullSafe(known), by_token)
        .when(~F.col("known_zero_one").eqNullSafe(known), "Numerical")
        .when(not_01.isNull(), "Binary")
        .when(F.col("not_01_number").eqNullSafe(not_01), "Numerical")
        .otherwise(by_token)
    )
    return summary.join(second_unknown, "feature", "left").select(
        "feature", "n_total", "n_valid",
        (F.col("n_total") - F.col("n_valid")).alias("n_na"),
        "n_numbers", family.alias("family"),
    )


def of_family(obs: DataFrame, families: DataFrame, family: str) -> DataFrame:
    """Observations of the features that belong to `family`.

    `families` is looked at twice (size check and join), so it should be a table or `cut`. While it
    is small the observations are filtered in place, without a shuffle by feature.
    """
    wanted = families.where(F.col("family") == family).select("feature")
    return obs.join(lookup_side(wanted), "feature", "left_semi")


def typed_values(obs: DataFrame, families: DataFrame) -> DataFrame:
    """Non-missing values with `value` parsed where the feature is numerical.

    A later non-number in a numerical feature becomes null and is flagged as unparsed. `families`
    should be a table or `cut`, as in `of_family`.
    """
    labelled = drop_missing(obs).join(
        lookup_side(families.select("feature", "family")), "feature")
    number = F.when(F.col("family") == "Numerical", to_number(F.col("raw")))
    return labelled.select(
        "feature", "sample_id", "family", "raw", number.alias("value"),
        ((F.col("family") == "Numerical") & number.isNull()).alias("unparsed"),
    )


def numeric_values(obs: DataFrame, families: DataFrame) -> DataFrame:
    """(feature, sample_id, value) of the numerical features, numbers only."""
    return (
        of_family(obs, families, "Numerical")
        .select("feature", "sample_id", to_number(F.col("raw")).alias("value"))
        .where(F.col("value").isNotNull())
    )


def family_counts(families: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: features per family, and normal / unknown among the numerical ones."""
    counts = families.agg(
        F.count(F.lit(1)).alias("n_features"),
        *[F.count_if(F.col("family") == name).alias(f"n_{name.lower()}") for name in FAMILIES],
    )
    normal = verdicts.agg(
        F.count_if(F.col("distribution") == "normal").alias("n_normal"),
        F.count_if(F.col("distribution") != "normal").alias("n_unknown"),
    )
    return counts.join(F.broadcast(normal), F.lit(True))


def missing_counts(obs: DataFrame) -> DataFrame:
    """(feature, n_na), one partially aggregated pass."""
    return obs.groupBy("feature").agg(F.count_if(is_missing(F.col("raw"))).alias("n_na"))


def value_summary(values: DataFrame) -> DataFrame:
    """Sufficient statistics per feature of (feature, value)."""
    value = F.col("value")
    return values.groupBy("feature").agg(
        F.count(value).alias("n"), F.mean(value).alias("mean"),
        F.var_pop(value).alias("var_pop"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Round the double itself half-even, as array libraries do."""
    return F.rint(x * 10.0 ** digits) / 10.0 ** digits


def feature_vectors(values: DataFrame, chunk: int = 4096) -> DataFrame:
    """Value vectors of a feature in pieces of at most `chunk` consecutive sample ids.

    Pieces keep every group bounded; a short feature is one piece.
    """
    piece = F.expr(f"sample_id div {int(chunk)}")
    cell = F.struct("sample_id", "value")
    return (
        values.groupBy("feature", piece.alias("piece"))
        .agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        .select("feature", "piece", F.col("cells.value").alias("vector"))
    )


def patient_maps(values: DataFrame) -> DataFrame:
    """One feature -> value map per sample; its size is the number of features."""
    entry = F.struct("feature", "value")
    return values.groupBy("sample_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values")
    )


def drop_positions(points: DataFrame, positions: list[int]) -> DataFrame:
    """Remove vector positions, several at once."""
    gone = set(positions)
    width = max(gone, default=-1) + 1
    # one mask literal looked up by position; positions beyond it stay
    mask = F.split(F.lit(",".join("false" if i in gone else "true" for i in range(width))), ",").cast(
        "array<boolean>")
    kept = F.filter("features", lambda _, i: F.coalesce(F.get(mask, i), F.lit(True)))
    return points.withColumn("features", kept) if gone else points


def distinct_in_order(items: DataFrame, key: str, position: str) -> DataFrame:
    """First position of every distinct key; sort by it to get first-seen order."""
    return items.groupBy(key).agg(F.min(position).alias(position))
