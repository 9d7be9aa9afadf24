"""Parsers for the text layouts of a study.

Each parser takes a DataFrame with a string column, so that the same code serves files
(`spark.read.text`), tables and streams of lines derived by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.tokens import to_number
from cohortlens.session import cut, lookup_side


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a row id: the file's place in name order times 2^40 plus the line's place in
    the file. Ids do not depend on how files are split: lines are numbered within each split, and
    the lines of the splits before are added.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    splits = rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file, then per split
    files = splits.select("file").distinct().withColumn("place", F.row_number().over(Window.orderBy("file")) - 1)
    starts = cut(splits.join(files, "file").select(
        "file", "block", (F.col("place") * (1 << 40) + F.coalesce(F.sum("n").over(before), F.lit(0))
                          - F.col("first")).alias("shift")))
    return rows.join(lookup_side(starts), ["file", "block"]).select(
        (F.col("row") + F.col("shift")).alias("sample_id"), "line")


def labeled_points(lines: DataFrame, line: str = "line", id_col: str = "sample_id") -> DataFrame:
    """`label f1 f2 ...` lines, space separated, to (sample_id, label, features)."""
    numbers = F.transform(F.split(F.col(line), " "), to_number)
    parsed = lines.select(F.col(id_col).alias("sample_id"), numbers.alias("numbers"))
    return parsed.select(
        "sample_id",
        F.element_at("numbers", 1).alias("label"),
        F.slice("numbers", 2, F.size("numbers") - 1).alias("features"),
    )


def feature_names(lines: DataFrame, line: str = "line", number: str | None = None) -> DataFrame:
    """The first space-separated header line to (pos, feature), pos from zero: the one with the
    smallest `number` (a column), without one the smallest line, whatever the order of rows."""
    first = lines.agg(F.min(F.col(line)) if number is None else F.min_by(line, number)).toDF("line")
    return first.select(F.posexplode(F.split("line", " ")).alias("pos", "feature"))


def header_names(files: DataFrame, text: str = "text", id_col: str = "file_id") -> DataFrame:
    """First line of every file to (file_id, pos, feature), for a study kept in many files."""
    header = F.split_part(F.col(text), F.lit("\n"), F.lit(1))
    return files.select(
        F.col(id_col).alias("file_id"), F.posexplode(F.split(header, " ")).alias("pos", "feature"))


def study_documents(documents: DataFrame, data_type: str) -> DataFrame:
    """Documents of one data type; the filter reaches the scan or its partitions."""
    return documents.where(F.col("DataType") == data_type).select("FeatureName", "FeatureValue")


def observations(documents: DataFrame) -> DataFrame:
    """Tab-joined value lists to one row per value: (feature, sample_id, raw)."""
    return documents.select(
        F.col("FeatureName").alias("feature"),
        F.posexplode(F.split("FeatureValue", "\t")).alias("pos", "raw"),
    ).select("feature", F.col("pos").cast("bigint").alias("sample_id"), "raw")


def feature_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """`name<TAB>v1<TAB>v2...` lines to (feature, sample_id, raw)."""
    cells = F.split(F.col(line), "\t")
    return lines.select(
        F.element_at(cells, 1).alias("feature"),
        F.posexplode(F.slice(cells, 2, F.size(cells) - 1)).alias("pos", "raw"),
    ).select("feature", F.col("pos").cast("bigint").alias("sample_id"), "raw")


def _after_colon(cell: Column) -> Column:
    return F.split_part(cell, F.lit(":"), F.lit(2))


def pathway_links(lines: DataFrame, line: str = "line") -> DataFrame:
    """`path:<pathway><TAB>org:<gene>` lines to (pathway, gene_id)."""
    return lines.select(
        _after_colon(F.split_part(F.col(line), F.lit("\t"), F.lit(1))).alias("pathway"),
        _after_colon(F.split_part(F.col(line), F.lit("\t"), F.lit(2)))
        .try_cast("bigint").alias("gene_id"),
    )


def symbol_map(lines: DataFrame, line: str = "line", order: str = "sample_id") -> DataFrame:
    """`symbol<TAB>id` lines to (symbol, gene_id); empty ids skipped, the last line wins."""
    cells = lines.select(
        F.col(order).alias("line_no"),
        F.split_part(F.col(line), F.lit("\t"), F.lit(1)).alias("symbol"),
        F.split_part(F.col(line), F.lit("\t"), F.lit(2)).try_cast("bigint").alias("gene_id"),
    ).where(F.col("gene_id").isNotNull())
    return cells.groupBy("symbol").agg(F.max_by("gene_id", "line_no").alias("gene_id"))


def gene_list(fields: DataFrame, field: str = "field") -> DataFrame:
    """A field of symbols separated by blanks or tabs to one row per symbol."""
    return fields.select(F.explode(F.split(F.col(field), r"\s+")).alias("symbol")).where(
        F.col("symbol") != ""
    )


def pathway_names(lines: DataFrame, line: str = "line", suffix: str = " - Homo sapiens (human)"
                  ) -> DataFrame:
    """`path:<pathway><TAB>name - organism` lines to (pathway, name)."""
    name = F.split_part(F.col(line), F.lit("\t"), F.lit(2))
    return lines.select(
        _after_colon(F.split_part(F.col(line), F.lit("\t"), F.lit(1))).alias("pathway"),
        F.when(F.endswith(name, F.lit(suffix)), F.left(name, F.length(name) - len(suffix)))
        .otherwise(name).alias("name"),
    )
