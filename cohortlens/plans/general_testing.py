"""General testing of a study: one report over all its features, without prior knowledge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.anova import anova_by_deviation
from cohortlens.operators.categorical import binomial_test, chi_square_equal, class_counts
from cohortlens.operators.correlation import heatmap_cells, pearson_matrix
from cohortlens.operators.normality import normality, order_totals
from cohortlens.operators.observations import family_counts, feature_families
from cohortlens.session import cut, scratch_path
from cohortlens.sources.study_store import read_family, write_study


@dataclass(frozen=True)
class GeneralTestingReport:
    families: DataFrame
    verdicts: DataFrame
    counts: DataFrame
    missing: DataFrame
    correlations: DataFrame
    chi_square: DataFrame
    binomial: DataFrame
    anova: DataFrame

    def heatmap(self) -> DataFrame:
        return heatmap_cells(self.correlations)

    def long(self) -> DataFrame:
        """All sections as rows: (section, item, other, metric, value)."""

        def rows(df: DataFrame, section: str, item, metrics: dict, other=None) -> DataFrame:
            pairs = F.array(*[
                F.struct(F.lit(name).alias("metric"), column.cast("double").alias("value"))
                for name, column in metrics.items()
            ])
            other = F.lit("") if other is None else other
            return df.select(
                F.lit(section).alias("section"), item.cast("string").alias("item"),
                other.alias("other"), F.inline(pairs))

        counts = {c: F.col(c) for c in self.counts.columns}
        parts = [
            rows(self.counts, "NumberOfData", F.lit("study"), counts),
            rows(self.missing, "NumberOfNAs", F.col("feature"), {"n_na": F.col("n_na")}),
            rows(self.correlations, "PearsonCorrelation", F.col("feature_x"),
                 {"r": F.col("r"), "p": F.col("p")}, F.col("feature_y")),
            rows(self.chi_square, "ChiSquareTest", F.col("feature"),
                 {"chi2": F.col("chi2"), "p": F.col("p")}),
            rows(self.binomial, "BinomialTest", F.col("feature"), {"p": F.col("p")}),
            rows(self.anova, "AnovaTest", F.format_number("std_bucket", 2),
                 {"n_features": F.col("n_features"), "f": F.col("f"), "p": F.col("p")}),
        ]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result


def general_testing(obs: DataFrame, level: float = 5.0, store: str | None = None,
                    data_type: str = "study") -> GeneralTestingReport:
    """Run every test that fits the inferred family of each feature.

    The raw study is read to infer the families and once more to write it typed, by family, under
    `store` (by default a new folder beside the checkpoints). Every section reads the partition of
    its family from there; each can be evaluated alone.
    """
    spark = obs.sparkSession
    families = cut(feature_families(obs))
    store = store or scratch_path(spark, "study")
    write_study(obs, families, store, data_type)

    def family(name: str) -> DataFrame:
        return read_family(spark, store, name, data_type)

    values = family("Numerical").where("value IS NOT NULL").select("feature", "sample_id", "value")
    totals = order_totals(values)
    verdicts = cut(normality(values, level, totals))
    normal = verdicts.where(F.col("distribution") == "normal").select("feature")
    return GeneralTestingReport(
        families=families,
        verdicts=verdicts,
        counts=family_counts(families, verdicts),
        missing=families.where(F.col("family") == "Numerical").select("feature", "n_na"),
        correlations=pearson_matrix(values),
        chi_square=chi_square_equal(class_counts(family("Categorical"))),
        binomial=binomial_test(class_counts(family("Binary"))),
        anova=anova_by_deviation(totals.join(normal, "feature", "left_semi")),
    )


def general_testing_document(report: GeneralTestingReport, most: int = 20) -> DataFrame:
    """One result row: counts, and per section the number of tests and the `most` with the smallest p
    (of missing values, the features that lack most). All rows are the report's own tables."""

    def gathered(df: DataFrame, name: str, order: list, *columns: str) -> DataFrame:
        size = df.agg(F.count(F.lit(1)).alias(f"{name}Rows"))
        first = df.orderBy(*order).limit(most)
        place = F.row_number().over(Window.orderBy(*order)).alias("_place")  # over at most `most` rows
        rows = first.select(place, *columns).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_place", *columns))),
                        lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias(name))
        return rows.join(F.broadcast(size), F.lit(True))  # one row each

    parts = [
        gathered(report.anova, "AnovaTest", ["p", "std_bucket"], "std_bucket", "n_features", "f", "p"),
        gathered(report.binomial, "BinomialTest", ["p", "feature"], "feature", "p"),
        gathered(report.chi_square, "ChiSquareTest", ["p", "feature"], "feature", "chi2", "p"),
        report.counts.select(F.struct(*report.counts.columns).alias("NumberOfData")),
        gathered(report.missing, "NumberOfNAs", [F.desc("n_na"), "feature"], "feature", "n_na"),
    ]
    document = parts[0]
    for part in parts[1:]:
        document = document.join(F.broadcast(part), F.lit(True))  # one row each
    return document.select(
        "*", F.current_timestamp().alias("EndTime"), F.lit("Completed").alias("Status"))
