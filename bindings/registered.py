"""The registered queries: every operator of the library bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import fixtures as X
from cohortlens.functions.tokens import to_number
from cohortlens.operators import anova as A
from cohortlens.operators import categorical as K
from cohortlens.operators import correction as M
from cohortlens.operators import correlation as C
from cohortlens.operators import elimination as EL
from cohortlens.operators import enrichment as E
from cohortlens.operators import goodness as G
from cohortlens.operators import linear_models as L
from cohortlens.operators import normality as N
from cohortlens.operators import observations as O
from cohortlens.operators import splits as S
from cohortlens.plans import cross_validation as CV
from cohortlens.plans import enrichment as PE
from cohortlens.plans import general_testing as GT
from cohortlens.session import cut, scratch_path
from cohortlens.sources import readers, results

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters shared with the oracle SQL.
SPLIT_SEED, TRAIN_FRACTION, CV_SEED, CV_RUNS = 7, 0.8, 3, 2
DESCENT_STEPS, DESCENT_TOLERANCE = 100, 1e-3
CURVE_DROP, CURVE_FLOOR = 0.25, 30
RESULT_FOLDERS = 64


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def r6(column: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(column, 6) + 0.0


def big(column: Column) -> Column:
    return column.cast("bigint")


# ------------------------------------------------------------------------------ sources, sinks


@query
def labeled_points(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", F.lit("1")).otherwise(F.lit("0"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    lines = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.concat_ws(" ", label, F.col("o_custkey"), cents, F.dayofyear("o_orderdate"))
        .alias("line"))
    points = readers.labeled_points(lines)
    return points.select(
        "sample_id", "label", big(F.size("features")).alias("n_features"),
        *[F.get("features", i).alias(f"f{i}") for i in range(3)])


@query
def feature_names(spark, d):
    files = X.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return readers.header_names(files).select("file_id", big(F.col("pos")).alias("pos"), "feature")


@query
def feature_names_line(spark, d):
    """The names of the nations as one header line."""
    lines = X.table(spark, d, "nation").agg(
        F.array_join(F.array_sort(F.collect_list("n_name")), " ").alias("line"))
    return readers.feature_names(lines).select(big(F.col("pos")).alias("pos"), "feature")


@query
def feature_lines(spark, d):
    lines = X.table(spark, d, "embeddings").select(F.concat(
        F.lit("v"), "vec_id", F.lit("\t"),
        F.array_join(F.col("embedding").cast("array<double>"), "\t")).alias("line"))
    return readers.feature_lines(lines).select(
        "feature", "sample_id", r6(to_number(F.col("raw"))).alias("value"))


@query
def study_scan(spark, d):
    documents = X.table(spark, d, "documents").select(
        F.col("lang").alias("DataType"),
        F.concat_ws("-", "source", "doc_id").alias("FeatureName"),
        F.col("text").alias("FeatureValue"))
    return readers.study_documents(documents, "en").select(
        "FeatureName", F.md5("FeatureValue").alias("digest"),
        big(F.length("FeatureValue")).alias("n_chars"))


@query
def observations_long(spark, d):
    cells = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.when(x < -0.2, F.lit("NA")).otherwise(x.cast("string")))
    documents = X.table(spark, d, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("FeatureName"),
        F.array_join(cells, "\t").alias("FeatureValue"))
    obs = readers.observations(documents)
    return obs.select("feature", "sample_id", (F.col("raw") == "NA").alias("missing"),
                      r6(to_number(F.col("raw"))).alias("value"))


@query
def pathway_links(spark, d):
    lines = X.brand_links(spark, d).select(F.concat(
        F.lit("path:"), "pathway", F.lit("\thsa:"), F.col("gene_id").cast("string")).alias("line"))
    return readers.pathway_links(lines)


def _symbol_lines(spark, d):
    key = F.col("c_custkey")
    return X.table(spark, d, "customer").select(
        key.alias("sample_id"),
        F.concat("c_mktsegment", F.lit("_"), (key % 200).cast("string"), F.lit("\t"),
                 F.when(key % 13 == 0, F.lit("")).otherwise(key.cast("string"))).alias("line"))


@query
def symbol_map(spark, d):
    return readers.symbol_map(_symbol_lines(spark, d))


@query
def gene_list(spark, d):
    fields = X.table(spark, d, "conversations").select(F.col("text").alias("field"))
    return readers.gene_list(fields).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query
def result_update(spark, d):
    target = X.table(spark, d, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("algorithm"), F.lit("pending").alias("status"),
        r6(F.col("c_acctbal")).alias("perf"))
    key = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1_000_000_000).otherwise(
        F.col("o_custkey"))
    updates = X.table(spark, d, "orders").groupBy(key.alias("c_custkey")).agg(
        F.lit("completed").alias("status"), r6(F.max("o_totalprice")).alias("perf"),
        F.count(F.lit(1)).alias("n_features"))
    return results.update_existing(target, updates, "c_custkey")


@query
def result_store_update(spark, d):
    """Stored results after an update: the rows, and which folders were replaced."""
    target = X.table(spark, d, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("algorithm"), F.lit("pending").alias("status"),
        r6(F.col("c_acctbal")).alias("perf"))
    path = scratch_path(spark, "results")
    results.store_results(target, path, "c_custkey", RESULT_FOLDERS)
    rich = X.table(spark, d, "orders").where("o_totalprice > 450000").select(
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey"))
        .alias("c_custkey"), F.lit("completed").alias("status"), r6(F.col("o_totalprice")).alias("perf"))
    touched = results.update_stored(spark, path, rich, "c_custkey", RESULT_FOLDERS, order=None)
    return results.read_results(spark, path).select(
        "*", results.bucket_of("c_custkey", RESULT_FOLDERS).isin(touched).alias("replaced"))


@query
def result_document(spark, d):
    """Families and missing values of the mixed study as one result row."""
    families = O.feature_families(X.mixed_study(spark, d))
    entry = F.struct("feature", F.concat_ws(
        ":", "feature", "family", F.col("n_valid").cast("string"), F.col("n_na").cast("string"))
        .alias("text"))
    return families.agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("n_na").alias("n_na"),
        F.array_join(F.array_sort(F.collect_list(entry))["text"], ",").alias("features"),
        F.lit("Completed").alias("status"))


# ------------------------------------------------------------------------ values and families


@query
def na_filter(spark, d):
    return O.drop_missing(X.mixed_study(spark, d)).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"),
        F.max("sample_id").alias("last_id"), F.sum(F.length("raw")).alias("n_chars"))


@query
def family_infer(spark, d):
    return O.feature_families(X.mixed_study(spark, d))


@query
def family_route(spark, d):
    study = X.mixed_study(spark, d)
    families = cut(O.feature_families(study))
    parts = [
        O.of_family(study, families, name).groupBy("feature").agg(
            F.lit(name).alias("family"), F.count(F.lit(1)).alias("n"))
        for name in ("Binary", "Numerical", "Categorical")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def typed_values(spark, d):
    study = X.mixed_study(spark, d)
    typed = O.typed_values(study, cut(O.feature_families(study)))
    return typed.groupBy("feature", "family").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"),
        F.count_if("unparsed").alias("n_unparsed"), r6(F.avg("value")).alias("mean"),
        r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"))


@query
def normal_features(spark, d):
    verdicts = N.normality(X.numeric_study(spark, d))
    return verdicts.where(F.col("distribution") == "normal").select("feature", "n")


@query
def feature_vectors(spark, d):
    vectors = O.feature_vectors(X.numeric_study(spark, d), chunk=128)
    return vectors.select(
        "feature", "piece", big(F.size("vector")).alias("n"),
        r6(F.get("vector", 0)).alias("head"), r6(F.element_at("vector", -1)).alias("tail"),
        r6(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x)).alias("total"))


@query
def patient_map(spark, d):
    maps = O.patient_maps(X.numeric_study(spark, d))
    return maps.select(
        "sample_id", big(F.size("values")).alias("n_features"),
        r6(F.col("values")["d00"]).alias("d00"), r6(F.col("values")["d17"]).alias("d17"))


@query
def feature_drop(spark, d):
    points = O.drop_positions(X.labeled_vectors(spark, d), [0, 5, 63])
    return points.select(
        "sample_id", "label", big(F.size("features")).alias("n_features"),
        r6(F.get("features", 0)).alias("head"), r6(F.get("features", 4)).alias("fifth"),
        r6(F.aggregate("features", F.lit(0.0), lambda t, x: t + x)).alias("total"))


@query
def dedupe_ordered(spark, d):
    items = X.table(spark, d, "lineitem").select(
        "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return O.distinct_in_order(items, "l_partkey", "position")


@query
def na_counts(spark, d):
    return O.missing_counts(X.mixed_study(spark, d))


@query
def feature_stats(spark, d):
    values = X.numeric_study(spark, d).unionByName(X.gappy_study(spark, d))
    summary = O.value_summary(values)
    return summary.select(
        "feature", "n", r6(F.col("mean")).alias("mean"), r6(F.sqrt("var_pop")).alias("std"),
        r6(F.col("min_value")).alias("low"), r6(F.col("max_value")).alias("high"),
        O.round_half_even(F.sqrt("var_pop")).alias("std_bucket"))


@query
def family_counts(spark, d):
    study = X.mixed_study(spark, d)
    families = cut(O.feature_families(study))
    verdicts = N.normality(O.numeric_values(O.drop_missing(study), families))
    return O.family_counts(families, verdicts)


@query
def split_sizes(spark, d):
    points = X.labeled_vectors(spark, d)
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(S.in_training(SPLIT_SEED, F.col("sample_id"), TRAIN_FRACTION))
        .alias("n_train")).select("n", "n_train", (F.col("n") - F.col("n_train")).alias("n_test"))


@query
def error_rate(spark, d):
    scored = X.table(spark, d, "labels").join(X.table(spark, d, "documents"), "doc_id").select(
        F.col("quality").alias("label"),
        F.when(F.col("n_chars") > 600, F.lit(1)).otherwise(F.lit(0)).alias("prediction"))
    found = L.error_rate(scored)
    return found.select("n", "n_wrong", r6(F.col("error")).alias("error"))


# -------------------------------------------------------------------------- statistical tests


@query
def shapiro_w(spark, d):
    values = X.numeric_study(spark, d).unionByName(X.gappy_study(spark, d))
    return N.shapiro_w(values).select("feature", "n", r6(F.col("shapiro_w")).alias("w"))


@query
def shapiro_threshold(spark, d):
    sizes = X.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("user_id", "n", N.shapiro_threshold(F.col("n")).alias("critical"))


@query
def anderson_a2(spark, d):
    return N.anderson_a2(X.numeric_study(spark, d)).select(
        "feature", "n", r6(F.col("anderson_a2")).alias("a2"))


@query
def normality_verdict(spark, d):
    verdicts = N.normality(X.numeric_study(spark, d), level=5.0)
    return verdicts.select(
        "feature", "n", r6(F.col("shapiro_w")).alias("w"), r6(F.col("anderson_a2")).alias("a2"),
        "anderson_critical", "shapiro_critical", "distribution")


@query
def anderson_levels(spark, d):
    """Verdict of the Anderson-Darling test at every level."""
    found = N.anderson_a2(X.numeric_study(spark, d))
    levels = F.array(*[F.struct(F.lit(level).alias("level"), N.anderson_threshold(F.col("n"), level).alias("critical"))
                       for level in (15.0, 10.0, 5.0, 2.5, 1.0)])
    return found.select("feature", "anderson_a2", F.inline(levels)).select(
        "feature", "level", "critical", (F.col("anderson_a2") < F.col("critical")).alias("below"))


@query
def non_finite_counts(spark, d):
    """Embedding cells with every 50th vector infinite and every 70th not a number."""
    key = F.col("sample_id")
    odd = F.when(key % 50 == 0, F.lit(float("inf"))).when(key % 70 == 1, F.lit(float("nan")))
    study = X.numeric_study(spark, d).withColumn("value", F.coalesce(odd, "value"))
    kept = O.finite_only(study).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))
    return O.non_finite_counts(study).join(kept, "feature")


@query
def pearson_non_finite(spark, d):
    key = F.col("sample_id")
    odd = F.when((key % 50 == 0) & (F.col("feature") == "d03"), F.lit(float("-inf"))).when(
        (key % 70 == 1) & (F.col("feature") < "d02"), F.lit(float("nan")))
    study = X.numeric_study(spark, d).withColumn("value", F.coalesce(odd, "value"))
    return _matrix(C.pearson_matrix(study))


@query
def anova_members(spark, d):
    study = X.numeric_study(spark, d)
    return A.anova_members(N.order_totals(study))


@query
def ks_uniform(spark, d):
    return N.ks_uniform(X.gappy_study(spark, d)).select(
        "feature", "n", r6(F.col("ks_d")).alias("ks_d"), r6(F.col("ks_p")).alias("ks_p"),
        "distribution")


def _prices_by_customer(spark, d):
    return X.table(spark, d, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("feature"), F.col("o_orderkey").alias("sample_id"),
        F.col("o_totalprice").cast("double").alias("value"))


@query
def ks_laws(spark, d):
    """Embedding dimensions, and the order prices of every customer, against each law: many values
    with the asymptotic p, few with the exact one."""
    values = X.numeric_study(spark, d).unionByName(_prices_by_customer(spark, d))
    return G.ks_test(values).select(
        "feature", "law", "n", r6(F.col("ks_d")).alias("ks_d"), r6(F.col("ks_p")).alias("ks_p"), "distribution")


@query
def ks_standard_normal(spark, d):
    """Scaled embedding dimensions against the normal law with given location and scale."""
    values = X.numeric_study(spark, d).withColumn("value", F.col("value") * 8)
    return G.ks_test(values, ["normal"], parameters={"normal": (0.0, 1.0)}).select(
        "feature", "n", r6(F.col("ks_d")).alias("ks_d"), r6(F.col("ks_p")).alias("ks_p"), "distribution")


def _matrix(found: DataFrame) -> DataFrame:
    return found.select("feature_x", "feature_y", "n", r6(F.col("r")).alias("r"),
                        r6(F.col("p")).alias("p"), "degenerate")


@query
def pairwise_align(spark, d):
    pairs = C.aligned_pairs(X.gappy_study(spark, d))
    return pairs.select("feature_x", "feature_y", "n", r6(F.col("mean_x")).alias("mean_x"),
                        r6(F.col("mean_y")).alias("mean_y"))


@query
def pearson_matrix(spark, d):
    values = X.numeric_study(spark, d).unionByName(X.gappy_study(spark, d))
    return _matrix(C.pearson_matrix(values))


@query
def spearman_matrix(spark, d):
    return _matrix(C.spearman_matrix(X.gappy_study(spark, d)))


@query
def corr_heatmap(spark, d):
    study = X.numeric_study(spark, d)
    cells = C.heatmap_cells(C.pearson_matrix(study), study.select("feature"))
    return cells.select("row", "col", "feature_x", "feature_y", r6(F.col("cell")).alias("cell"))


def _user_events(spark, d):
    return X.table(spark, d, "events").select(
        F.concat(F.lit("user_"), "user_id").alias("feature"),
        F.col("event_id").alias("sample_id"), F.col("event_type").alias("raw"))


@query
def class_counts(spark, d):
    return K.class_counts(_user_events(spark, d))


@query
def chisq_gof(spark, d):
    whole = X.table(spark, d, "events").select(
        F.lit("event_type").alias("feature"), F.col("event_id").alias("sample_id"),
        F.col("event_type").alias("raw"))
    priority = X.table(spark, d, "orders").select(
        F.lit("priority").alias("feature"), F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderpriority").alias("raw"))
    single = priority.select(F.lit("single").alias("feature"), "sample_id", F.lit("x").alias("raw"))
    obs = whole.unionByName(priority).unionByName(single).unionByName(_user_events(spark, d))
    tests = K.chi_square_equal(K.class_counts(obs))
    return tests.select("feature", "n_classes", "n", r6(F.col("chi2")).alias("chi2"),
                        r6(F.col("p")).alias("p"))


@query
def binomial_test(spark, d):
    labels = X.table(spark, d, "labels")
    obs = labels.select(F.col("doc_id").alias("sample_id"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(name).cast("string").alias("raw"))
        for name in ("quality", "toxic")])))
    obs = obs.unionByName(_user_events(spark, d)).unionByName(
        X.table(spark, d, "orders").select(
            F.col("o_orderkey").alias("sample_id"), F.lit("status").alias("feature"),
            F.col("o_orderstatus").alias("raw")))
    tests = K.binomial_test(K.class_counts(obs))
    return tests.select("feature", "low", "high", r6(F.col("p")).alias("p"))


@query
def anova_by_std(spark, d):
    values = X.numeric_study(spark, d)
    totals = N.order_totals(values)
    normal = N.normality(values, totals=totals).where(F.col("distribution") == "normal")
    tests = A.anova_by_deviation(totals.join(normal.select("feature"), "feature", "left_semi"))
    return tests.select("std_bucket", "n_features", "n_values", r6(F.col("f")).alias("f"),
                        r6(F.col("p")).alias("p"))


# -------------------------------------------------------------------------------- enrichment


@query
def symbol_to_id(spark, d):
    symbols = X.table(spark, d, "orders").select(
        F.format_string("Customer#%09d", F.col("o_custkey") * 2).alias("symbol"))
    mapping = X.table(spark, d, "customer").select(
        F.col("c_name").alias("symbol"), F.col("c_custkey").alias("gene_id"))
    return E.symbols_to_ids(symbols, mapping)


@query
def pathway_overlap(spark, d):
    return E.pathway_overlap(X.brand_links(spark, d), X.returned_parts(spark, d))


@query
def contingency_table(spark, d):
    ids = X.returned_parts(spark, d)
    overlap = E.with_list_size(E.pathway_overlap(X.brand_links(spark, d), ids), ids)
    overlap = overlap.join(F.broadcast(X.part_universe(spark, d)), F.lit(True))
    return E.contingency(overlap, F.col("universe"))


def _brand_tests(spark, d) -> DataFrame:
    return PE.all_tests(
        X.brand_links(spark, d), X.returned_parts(spark, d), X.part_universe(spark, d))


@query
def fisher_enrichment(spark, d):
    return _brand_tests(spark, d).select(
        "pathway", "a", "b", "c", "d", r6(F.col("odds_ratio")).alias("odds_ratio"),
        r6(F.col("p")).alias("p"), r6(F.col("log10_p")).alias("log10_p"))


def _top(spark, d, correction, n_tests="topk") -> DataFrame:
    top = PE.enrich(X.brand_links(spark, d), X.returned_parts(spark, d), correction,
                    universe=X.part_universe(spark, d), n_tests=n_tests)
    return top.select("pathway", "a", r6(F.col("p")).alias("p"), r6(F.col("log10_p")).alias("log10_p"),
                      r6(F.col("p_corrected")).alias("p_corrected"))


@query
def enrichment_top5(spark, d):
    return _top(spark, d, "Bonferroni")


@query
def enrichment_document(spark, d):
    ids = X.returned_parts(spark, d)
    top = PE.enrich(X.brand_links(spark, d), ids, "Bonferroni", universe=X.part_universe(spark, d))
    document = PE.enrichment_document(top, ids, "Bonferroni", "returned parts")
    return document.select(
        F.posexplode("TopPathways").alias("pos", "t"), "KeggTopPathway", "NumberOfGenes", "Correction",
        "CustomField", "Status").select(
        big(F.col("pos")).alias("pos"), F.col("t.pathway").alias("pathway"), r6(F.col("t.p")).alias("p"),
        F.col("KeggTopPathway").alias("top"), F.col("NumberOfGenes").alias("n_genes"),
        F.col("Correction").alias("correction"), F.col("CustomField").alias("custom"),
        F.col("Status").alias("status"))


@query
def gene_listing(spark, d):
    symbols = X.table(spark, d, "orders").select(
        F.format_string("Customer#%09d", F.col("o_custkey") * 2).alias("symbol"))
    mapping = X.table(spark, d, "customer").select(
        F.col("c_name").alias("symbol"), F.col("c_custkey").alias("gene_id"))
    return PE.gene_listing(symbols, mapping)


def _corrected(spark, d, method) -> DataFrame:
    return M.correct(_brand_tests(spark, d).select("pathway", "p"), method).select(
        "pathway", r6(F.col("p")).alias("p"), r6(F.col("p_corrected")).alias("p_corrected"))


@query
def correct_bonferroni(spark, d):
    return _corrected(spark, d, "Bonferroni")


@query
def correct_sidak(spark, d):
    return _corrected(spark, d, "Sidak")


@query
def correct_holm(spark, d):
    return _corrected(spark, d, "HB")


@query
def enrichment_named(spark, d):
    customer = X.table(spark, d, "customer")
    lines = X.table(spark, d, "nation").select(F.concat(
        F.lit("path:nat"), F.col("n_nationkey").cast("string"), F.lit("\t"), "n_name",
        F.lit(" - Homo sapiens (human)")).alias("line"))
    links = customer.select(
        F.concat(F.lit("nat"), F.col("c_nationkey").cast("string")).alias("pathway"),
        F.col("c_custkey").alias("gene_id"))
    rich = X.table(spark, d, "orders").where(F.col("o_totalprice") >= 450000).select(
        F.col("o_custkey").alias("gene_id"))
    universe = customer.agg(F.count(F.lit(1)).alias("universe"))
    top = PE.enrich(links, rich, "Sidak", universe=universe, n_tests="all")
    return PE.with_names(top, readers.pathway_names(lines)).select(
        "pathway", "name", r6(F.col("p")).alias("p"), r6(F.col("p_corrected")).alias("p_corrected"))


# ---------------------------------------------------------------------------- cross-validation


@query
def cv_split(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", S.in_training(
        SPLIT_SEED, F.col("o_orderkey"), TRAIN_FRACTION).alias("training"))


@query
def cv_resample_sizes(spark, d):
    points = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return S.resample_sizes(points, [SPLIT_SEED + run for run in range(5)], TRAIN_FRACTION)


@query
def score_linear(spark, d):
    weights = [((i * 37) % 11 - 5) / 10.0 for i in range(len(X.vector_names(spark, d)))]
    return X.labeled_vectors(spark, d).select(
        "sample_id", "label", L.score(weights).alias("score")).select(
        "sample_id", "label", r6(F.col("score")).alias("score"),
        F.when(F.col("score") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction"))


def _cross_validate(spark, d, name, **options) -> CV.CrossValidationResult:
    settings = {"train_fraction": TRAIN_FRACTION, "runs": CV_RUNS, "seed": CV_SEED,
                "iterations": DESCENT_STEPS, "tolerance": DESCENT_TOLERANCE, "floor": 64, **options}
    return CV.cross_validate(
        X.labeled_vectors(spark, d), X.vector_names(spark, d), name, **settings)


def _validated(result: CV.CrossValidationResult) -> DataFrame:
    weights = result.weights.groupBy("run", "step").agg(
        F.sum("weight").alias("weight_sum"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("weight_norm"))
    return result.curve.join(weights, ["run", "step"]).select(
        "run", "step", "n_features", "n", "n_wrong", r6(F.col("error")).alias("error"),
        r6(F.col("rmse")).alias("rmse"), r6(F.col("weight_sum")).alias("weight_sum"),
        r6(F.col("weight_norm")).alias("weight_norm"))


@query
def cv_svm(spark, d):
    return _validated(_cross_validate(spark, d, "SVM"))


@query
def cv_logit(spark, d):
    return _validated(_cross_validate(spark, d, "LogisticRegressionWithSGD"))


@query
def cv_linreg(spark, d):
    return _validated(_cross_validate(spark, d, "LinearRegressionWithSGD"))


@query
def cv_lasso(spark, d):
    return _validated(_cross_validate(spark, d, "LassoWithSGD"))


def _optimal(spark, d, name) -> DataFrame:
    """Per run the validation rows and whether the fit over all features is the optimum: the
    gradient of the loss over the training rows, at the fitted weights, against that at zero."""
    points, names = X.labeled_vectors(spark, d), X.vector_names(spark, d)
    result = CV.cross_validate(points, names, name, train_fraction=TRAIN_FRACTION, runs=CV_RUNS,
                               seed=CV_SEED, engine="estimator", floor=len(names))
    weights = result.weights.groupBy("run").agg(
        F.sort_array(F.collect_list(F.struct("feature", "weight"))).alias("w"))  # one row per run
    flags = F.array(*[S.in_training(CV_SEED + run, F.col("sample_id"), TRAIN_FRACTION)
                      for run in range(CV_RUNS)])
    rows = points.select("label", "features", F.posexplode(flags).alias("run", "training")).where(
        "training").join(F.broadcast(weights), "run")
    margin = F.aggregate(F.zip_with("features", "w", lambda x, w: x * w["weight"]), F.lit(0.0),
                         lambda total, x: total + x)
    logistic = L.algorithm(name).loss == "logistic"
    at_fit = (1 / (1 + F.exp(-margin)) if logistic else margin) - F.col("label")
    at_zero = F.lit(0.5 if logistic else 0.0) - F.col("label")
    slopes = rows.select("run", at_fit.alias("fit"), at_zero.alias("zero"), F.posexplode("features").alias("pos", "x"))
    sums = slopes.groupBy("run", "pos").agg(
        F.abs(F.sum(F.col("fit") * F.col("x"))).alias("fit"), F.abs(F.sum(F.col("zero") * F.col("x"))).alias("zero"))
    done = sums.groupBy("run").agg((F.max("fit") < 1e-3 * F.max("zero")).alias("optimal"))
    return result.curve.join(done, "run").select("run", "n_features", "n", "optimal")


@query
def cv_logit_lbfgs(spark, d):
    """All runs and elimination steps at the minimum of the loss."""
    result = _cross_validate(spark, d, "LogisticRegressionWithLBFGS", drop=CURVE_DROP, floor=CURVE_FLOOR)
    weights = result.weights.groupBy("run", "step").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("weight_norm"))
    return result.curve.join(weights, ["run", "step"]).select(
        "run", "step", "n_features", "n", "n_wrong", r6(F.col("error")).alias("error"),
        (F.round("weight_norm", 2) + 0.0).alias("weight_norm"))


def _fixed_weights(width: int) -> list[list[float]]:
    return [[((i * a) % 11 - 5) / 10.0 for i in range(width)] for a in (37, 17)]


@query
def model_auc(spark, d):
    """AUC of two given models on the validation rows of every run."""
    weights = _fixed_weights(len(X.vector_names(spark, d)))
    points = CV.prepare(X.labeled_vectors(spark, d), [CV_SEED + run for run in range(CV_RUNS)], TRAIN_FRACTION)
    runs = [run for run in range(CV_RUNS) for _ in weights]
    found = L.model_auc(points, weights * CV_RUNS, runs)
    return found.select("model", "n_positive", "n_negative", r6(F.col("auc")).alias("auc"))


@query
def cv_document(spark, d):
    """Result rows of an elimination, the curve as JSON; the weights of the chosen models are sums."""
    result = _cross_validate(spark, d, "LinearRegressionWithSGD", drop=CURVE_DROP, floor=CURVE_FLOOR)
    curve = F.transform("PerformanceCurve", lambda s: F.struct(s["step"].alias("step"), s["n_features"].alias("n_features"),
                                                               s["n_wrong"].alias("n_wrong")))
    weights = result.best_weights().groupBy("run").agg(r6(F.sum("weight")).alias("weight_sum"))
    return result.documents().join(weights, "run").select(
        "run", r6(F.col("ModelPerf")).alias("perf"), F.col("ModelStep").alias("step"),
        F.col("NumberOfFeatures").alias("n_features"), F.to_json(curve).alias("curve"), "weight_sum",
        F.col("AlgorithmUsed").alias("algorithm"), F.col("WorkflowSpecificParameters").alias("parameters"),
        F.col("Status").alias("status"))


@query
def cv_linreg_estimator(spark, d):
    return _optimal(spark, d, "LinearRegressionWithSGD")


@query
def logit_train_error(spark, d):
    points = X.labeled_vectors(spark, d).select(
        "label", "features", F.array(F.lit(True)).alias("in_train"))
    spec = L.algorithm("LogisticRegressionWithSGD")
    width = len(X.vector_names(spark, d))
    weights = L.fit_by_gradient(points, [[True] * width], [0], spec, DESCENT_STEPS, DESCENT_TOLERANCE)
    errors = L.validation_errors(points, weights, [0], spec.cut_off, validation=False)
    return errors.select("n", "n_wrong", r6(F.col("error")).alias("error"))


@query
def eliminate_step(spark, d):
    features = X.table(spark, d, "embeddings").select(
        F.posexplode("embedding").alias("pos", "x")).select("pos").distinct().select(
        big(F.col("pos")).alias("pos"), F.format_string("d%02d", "pos").alias("feature"))
    return EL.eliminate_step(features, CV_SEED, 1, CURVE_DROP)


def _curve(spark, d) -> CV.CrossValidationResult:
    return _cross_validate(spark, d, "LogisticRegressionWithSGD", drop=CURVE_DROP, floor=CURVE_FLOOR)


@query
def elimination_curve(spark, d):
    return _curve(spark, d).curve.select(
        "run", "step", "n_features", "n", "n_wrong", r6(F.col("error")).alias("error"))


@query
def best_model(spark, d):
    result = _curve(spark, d)
    return result.best_weights().join(F.broadcast(result.best().select("run", "n_features", "error")),
                                      "run").select(
        "run", "step", "n_features", r6(F.col("error")).alias("error"), "feature",
        r6(F.col("weight")).alias("weight"))


@query
def cv_enrichment(spark, d):
    """Features kept by the best models of the runs, as symbols, through the enrichment."""
    symbols = _curve(spark, d).best_weights().select(F.col("feature").alias("symbol"))
    part = X.table(spark, d, "part")
    mapping = part.select(
        F.format_string("d%02d", "p_partkey").alias("symbol"), F.col("p_partkey").alias("gene_id"))
    links = part.select(
        F.concat_ws("-", "p_type", (F.col("p_partkey") % 7).cast("string")).alias("pathway"),
        F.col("p_partkey").alias("gene_id"))
    top = PE.enrich_symbols(links, symbols, mapping, "Bonferroni",
                            universe=X.part_universe(spark, d))
    return top.select("pathway", "a", r6(F.col("p")).alias("p"),
                      r6(F.col("p_corrected")).alias("p_corrected"))


@query
def general_testing_report(spark, d):
    report = GT.general_testing(X.mixed_study(spark, d))
    return report.long().select("section", "item", "other", "metric",
                                r6(F.col("value")).alias("value"))


@query
def general_testing_document(spark, d):
    """The result row of the report, sections as JSON with p in millionths."""
    document = GT.general_testing_document(GT.general_testing(X.mixed_study(spark, d)), most=3)

    def section(name: str, *columns: str) -> Column:
        def field(r: Column, c: str) -> Column:
            return big(F.round(r["p"] * 1e6)) if c == "p" else r[c]
        return F.to_json(F.transform(name, lambda r: F.struct(*[field(r, c).alias(c) for c in columns])))

    return document.select(
        F.to_json("NumberOfData").alias("numbers"), section("BinomialTest", "feature", "p").alias("binomial"),
        section("ChiSquareTest", "feature", "p").alias("chi_square"),
        section("NumberOfNAs", "feature", "n_na").alias("missing"), F.col("BinomialTestRows").alias("n_binomial"),
        F.col("ChiSquareTestRows").alias("n_chi_square"), F.col("NumberOfNAsRows").alias("n_missing"),
        F.col("AnovaTestRows").alias("n_anova"), F.col("Status").alias("status"))
