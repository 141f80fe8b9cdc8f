"""One query per operator, bound to the given tables. Each result has plain types: BIGINT counts,
DOUBLE figures rounded to six places, text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck import analyze, analyze_scored
from pulsecheck.config import CURRENT, PERIOD, REFERENCE
from pulsecheck.functions.expressions import as_category
from pulsecheck.functions.literal import literal_table
from pulsecheck.operators import (
    calibration,
    categories,
    charts,
    columns,
    drift,
    health,
    performance,
    prepare,
    profile,
    quality,
    report,
    segments,
    split,
    surrogate,
    threshold,
)
from pulsecheck.sources import csv
from pulsecheck.sources.pairs import Pair, pair_from, pair_of
from pulsecheck.sources.shared import fresh_path
from workload.fixture import CATEGORICAL, NUMERIC, scored, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
KEY = ["l_orderkey", "l_linenumber"]
QUALITY_COLUMNS = [*NUMERIC, *CATEGORICAL, "y_true"]
TIERS = ["Basic", "Plus", "Premium"]


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(function(spark, sf_dir))

    REGISTERED[function.__name__] = run
    return function


def tidy(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- inputs -----------------------------------------------------------------------------------


def period(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scored(spark, sf).where(F.col(PERIOD) == name)


def plain_pair(spark: SparkSession, sf: str) -> Pair:
    return pair_from(scored(spark, sf), QUALITY_COLUMNS)


def uneven_pair(spark: SparkSession, sf: str) -> Pair:
    """Sides that differ: `y_value` only in reference, `pred_value` only in current, `pred` retyped."""
    ref = period(spark, sf, REFERENCE).select("usage", "discount", "flag", "pred", "y_value")
    cur = period(spark, sf, CURRENT).select("usage", "discount", "flag", F.col("pred").cast("string"), "pred_value")
    return pair_of(ref, cur)


def binary_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(PERIOD, *CATEGORICAL, "y_true", F.col("pred").alias("y_pred"), "proba")


def tier_probabilities() -> Column:
    q = (F.col("pred_value") - 1000.0) / 50.0 / 50.0
    return F.array((1.0 - q) * (1.0 - q), 2.0 * q * (1.0 - q), q * q)


def multiclass_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        PERIOD,
        *CATEGORICAL,
        F.col("tier").alias("y_true"),
        F.col("pred_tier").alias("y_pred"),
        tier_probabilities().alias("probabilities"),
    )


def regression_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        PERIOD, *CATEGORICAL, F.col("y_value").alias("y_true"), F.col("pred_value").alias("y_pred")
    )


ROWS = {"binary": binary_rows, "multiclass": multiclass_rows, "regression": regression_rows}


def performance_of(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    rows = ROWS[kind](spark, sf)
    metrics = performance.task_metrics(rows, kind, TIERS, "probabilities" if kind == "multiclass" else None)
    return performance.performance_table(metrics, kind)


def segments_of(spark: SparkSession, sf: str, kind: str = "binary") -> DataFrame:
    pair = pair_from(scored(spark, sf), CATEGORICAL)
    return segments.weak_segments(ROWS[kind](spark, sf), pair, CATEGORICAL, kind)


def drift_of(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_table(plain_pair(spark, sf), NUMERIC, CATEGORICAL)


def quality_of(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_table(plain_pair(spark, sf), "y_true")


def calibration_of(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.calibration_assessment(binary_rows(spark, sf))


def sweep_of(spark: SparkSession, sf: str) -> DataFrame:
    return threshold.threshold_sweep(binary_rows(spark, sf))


def analysis_of(spark: SparkSession, sf: str, kind: str = "binary"):
    target = {"binary": "y_true", "multiclass": "tier", "regression": "y_value"}[kind]
    pair = pair_from(scored(spark, sf), [*NUMERIC, *CATEGORICAL, target])
    probabilities = "probabilities" if kind == "multiclass" else None
    return analyze_scored(
        ROWS[kind](spark, sf), pair, kind, NUMERIC, CATEGORICAL, target, classes=TIERS, probabilities=probabilities
    )


# --- sources and sinks ------------------------------------------------------------------------


@query
def scan_csv(spark, sf):
    path = fresh_path(spark, "orders-csv")
    table(spark, sf, "orders").write.option("header", True).csv(path)
    read = csv.read_csv(spark, path)
    return read.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp").cast("string"))


@query
def sink_csv_roundtrip(spark, sf):
    path = fresh_path(spark, "quality-csv")
    csv.write_csv(quality_of(spark, sf), path)
    return csv.read_csv(spark, path)


@query
def csv_documents(spark, sf):
    """Whole texts, line breaks and all, out to CSV and back."""
    path = fresh_path(spark, "documents-csv")
    csv.write_csv(table(spark, sf, "documents"), path)
    return csv.read_csv(spark, path, multi_line=True).select("doc_id", F.md5("text").alias("md5"), "lang", "source", "n_chars")


def odd_orders(spark: SparkSession, sf: str) -> str:
    """Orders as CSV lines: keys of 19 digits, lone quotes, and every 50th row with a field too many."""
    path = fresh_path(spark, "odd-csv")
    key = "CAST(o_orderkey + 1234567890000000000 AS STRING)"
    line = f"concat_ws(',', {key}, concat(o_orderkey % 97, '\" pipe'), concat('\"', o_orderstatus, ',\"\"x\"\"\"'), IF(o_orderkey % 50 = 0, 'a,b', 'a'))"
    rows = table(spark, sf, "orders").selectExpr(f"{line} AS value")
    rows.coalesce(1).createOrReplaceTempView("__odd_orders")
    spark.sql("SELECT 'id,size,status,last' AS value UNION ALL SELECT value FROM __odd_orders").coalesce(1).write.text(path)
    return path


@query
def csv_large_ids(spark, sf):
    """Whole numbers of 19 digits, quotes inside fields, and rows with a field too many left out."""
    return csv.read_csv(spark, odd_orders(spark, sf), broken="drop")


@query
def csv_broken_rows(spark, sf):
    """The rows with a field too many, as they stand in the file."""
    return csv.broken_rows(spark, odd_orders(spark, sf)).select("n_fields", "record")


@query
def scan_two_tables(spark, sf):
    pair = uneven_pair(spark, sf)
    return pair.rows.groupBy(PERIOD).agg(
        F.count("*").alias("n"),
        F.sum("usage").alias("usage"),
        F.count("pred").alias("n_pred"),
        F.count("y_value").alias("n_y_value"),
        F.count("pred_value").alias("n_pred_value"),
    )


# --- splits -----------------------------------------------------------------------------------


@query
def split_by_time(spark, sf):
    labelled, _ = split.split_periods(table(spark, sf, "events"), ["event_id"], 0.60, "ts")
    return labelled.select("event_id", PERIOD)


@query
def split_by_instant(spark, sf):
    """By a column of instants."""
    rows = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    labelled, _ = split.split_periods(rows, ["event_id"], 0.45, "at")
    return labelled.select("event_id", PERIOD)


@query
def time_parse_share(spark, sf):
    # on a fifth of the types the text is no time
    odd = F.when(F.col("event_type") == "error", F.lit("no time")).otherwise(F.col("ts").cast("string"))
    return split.time_parse_share(table(spark, sf, "events").withColumn("ts", odd), "ts").drop("written", "ambiguous")


@query
def split_by_time_text(spark, sf):
    """By dates as texts with the month in front."""
    rows = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "MM/dd/yyyy"))
    labelled, _ = split.split_periods(rows, ["o_orderkey"], 0.6, "day")
    return labelled.select("o_orderkey", PERIOD)


@query
def time_ways(spark, sf):
    """How the same dates are read, written in several ways."""
    orders = table(spark, sf, "orders")
    found = None
    for written in ("MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyyMMdd", "MMM dd, yyyy", "yyyy-MM-dd HH:mm:ss"):
        row = split.time_parse_share(orders.select(F.date_format("o_orderdate", written).alias("t")), "t")
        row = row.select(F.lit(written).alias("pattern"), "n_rows", "n_parsed", "accepted", "written", "ambiguous")
        found = row if found is None else found.unionByName(row)
    return found


@query
def split_by_order(spark, sf):
    labelled, _ = split.split_periods(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 0.75)
    return labelled.select("o_orderkey", PERIOD)


@query
def split_train_holdout(spark, sf):
    rows = split.split_train_holdout(period(spark, sf, REFERENCE), "discount", KEY)
    return rows.select(*KEY, "part")


@query
def labels_complete(spark, sf):
    rows = scored(spark, sf)
    parts = [
        split.labels_complete(rows, target).withColumn("target", F.lit(target)) for target in ("y_true", "discount", "tier")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- columns ----------------------------------------------------------------------------------


@query
def feature_columns(spark, sf):
    pair = uneven_pair(spark, sf)
    numeric, categorical = columns.feature_columns(pair, "pred")
    stats = quality.column_stats(pair, [*numeric, *categorical])
    kind = F.when(F.col("column").isin(numeric), "numeric").otherwise("categorical")
    return stats.select("column", kind.alias("kind"), (F.col("ref_rows") - F.col("ref_missing")).alias("ref_values"))


@query
def infer_task_type(spark, sf):
    found = None
    for name, target in (("labels", "quality"), ("embeddings", "label"), ("orders", "o_totalprice")):
        facts = columns.task_facts(table(spark, sf, name), target).withColumn("target", F.lit(f"{name}.{target}"))
        found = facts if found is None else found.unionByName(facts)
    return found


@query
def class_list(spark, sf):
    return columns.class_list(table(spark, sf, "embeddings"), "label")


@query
def target_candidates(spark, sf):
    return columns.target_candidates(table(spark, sf, "orders"))


@query
def id_candidates(spark, sf):
    return columns.id_candidates(table(spark, sf, "customer"))


@query
def constant_columns(spark, sf):
    rows = period(spark, sf, REFERENCE).withColumn("nothing", F.lit(None).cast("double"))
    return columns.constant_columns(rows)


@query
def suggested_exclusions(spark, sf):
    rows = period(spark, sf, REFERENCE).withColumn("row_key", F.concat_ws("-", *KEY)).drop("l_orderkey")
    return columns.suggested_exclusions(rows, "y_true", "pred", "proba")


# --- profile ----------------------------------------------------------------------------------


@query
def profile_summary(spark, sf):
    return profile.profile_summary(scored(spark, sf))


@query
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents"), ["text"])


@query
def duplicate_whole_rows(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"))


def _leaky(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.select(
        "doc_id",
        "toxic",
        "quality",
        F.col("quality").cast("string").alias("copied"),
        (F.col("quality") * 2 + 1).alias("shifted"),
        F.when(F.col("doc_id") % 4 != 0, F.col("quality")).alias("partial"),
    )


@query
def leakage_equality(spark, sf):
    return profile.leakage_candidates(_leaky(spark, sf), "quality").where(F.col("reason") == "equality")


@query
def leakage_correlation(spark, sf):
    return profile.leakage_evidence(_leaky(spark, sf), "quality").select(
        "column", "n_comparable", F.abs("correlation").alias("strength")
    )


@query
def target_distribution(spark, sf):
    return profile.target_distribution(scored(spark, sf), "tax")


# --- quality ----------------------------------------------------------------------------------


@query
def missing_rates(spark, sf):
    return quality.missing_rates(plain_pair(spark, sf))


@query
def distinct_counts(spark, sf):
    return quality.distinct_counts(plain_pair(spark, sf))


@query
def type_changes(spark, sf):
    return quality.type_changes(uneven_pair(spark, sf))


@query
def new_categories(spark, sf):
    return quality.new_categories(plain_pair(spark, sf))


@query
def missing_columns(spark, sf):
    return quality.one_sided_columns(uneven_pair(spark, sf))


@query
def quality_status(spark, sf):
    return quality.quality_status(uneven_pair(spark, sf))


class in_zone:
    """Queries that are built inside have this time zone."""

    def __init__(self, spark: SparkSession, zone: str) -> None:
        self.spark, self.zone = spark, zone

    def __enter__(self) -> None:
        self.before = self.spark.conf.get("spark.sql.session.timeZone")
        self.spark.conf.set("spark.sql.session.timeZone", self.zone)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set("spark.sql.session.timeZone", self.before)


def repeated_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Events as instants around an hour that clocks show twice, a minute apart."""
    return table(spark, sf, "events").select("event_id", F.timestamp_seconds(F.lit(1730606400) + 60 * (F.col("event_id") % 240)).alias("at"))


@query
def duplicate_instants(spark, sf):
    with in_zone(spark, "America/New_York"):
        return profile.duplicate_rows(repeated_hour(spark, sf), ["at"])


@query
def quality_of_instants(spark, sf):
    """Instants, and whole numbers beside doubles, told apart by more than their text or their nearest double."""
    with in_zone(spark, "America/New_York"):
        rows = repeated_hour(spark, sf).withColumn("big", F.lit(1 << 53) + F.col("event_id") % 9)
        ref = rows.where("event_id % 2 = 0").select("at", "big")
        cur = rows.where("event_id % 2 = 1").select("at", F.col("big").cast("double").alias("big"))
        return quality.distinct_counts(pair_of(ref, cur))


@query
def quality_table(spark, sf):
    return quality_of(spark, sf)


# --- drift ------------------------------------------------------------------------------------


@query
def coerce_numeric(spark, sf):
    rows = scored(spark, sf)
    text = F.when(F.col("flag") == "R", "n/a").otherwise(F.col("usage").cast("string"))
    return drift.coerce_numeric(pair_from(rows.withColumn("usage", text), ["usage", "tax"]), ["usage", "tax"])


@query
def psi_bin_edges(spark, sf):
    return drift.psi_bin_edges(plain_pair(spark, sf), NUMERIC)


@query
def psi_histogram(spark, sf):
    return drift.psi_histogram(plain_pair(spark, sf), NUMERIC)


@query
def psi(spark, sf):
    return drift.psi(plain_pair(spark, sf), NUMERIC)


@query
def ks_statistic(spark, sf):
    return drift.ks_statistic(plain_pair(spark, sf), NUMERIC)


@query
def ks_pvalue(spark, sf):
    return drift.ks_pvalue(plain_pair(spark, sf), NUMERIC)


@query
def mean_shift(spark, sf):
    return drift.mean_shift(plain_pair(spark, sf), NUMERIC)


def _event_pair(spark, sf):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    events = table(spark, sf, "events").withColumn(PERIOD, F.when(late, CURRENT).otherwise(REFERENCE))
    return pair_from(events, ["event_type", "value"])


@query
def category_shares(spark, sf):
    return drift.category_shares(_event_pair(spark, sf), ["event_type"])


@query
def js_divergence(spark, sf):
    return drift.js_divergence(plain_pair(spark, sf), CATEGORICAL)


@query
def category_mode(spark, sf):
    return drift.category_mode(plain_pair(spark, sf), CATEGORICAL)


@query
def ks_pvalue_exact(spark, sf):
    """Small samples: the suppliers' balances by odd and even key."""
    rows = table(spark, sf, "supplier")
    side = F.when(F.col("s_suppkey") % 3 == 0, CURRENT).otherwise(REFERENCE)
    return drift.ks_pvalue(pair_from(rows.withColumn(PERIOD, side), ["s_acctbal"]), ["s_acctbal"])


@query
def drift_table(spark, sf):
    return drift_of(spark, sf)


# --- target and prediction --------------------------------------------------------------------


@query
def encode_binary(spark, sf):
    rows = scored(spark, sf)
    return rows.select(*KEY, prepare.encode_binary(rows, "flag", "R").alias("encoded"))


@query
def encode_multiclass(spark, sf):
    rows = scored(spark, sf)
    classes = prepare.class_table(rows.where(F.col(PERIOD) == REFERENCE), "tier")
    return prepare.encode_multiclass(rows, "pred_tier", classes, "class_index").select(*KEY, "class_index")


@query
def encode_regression(spark, sf):
    rows = scored(spark, sf).withColumn("y_value", F.col("y_value").cast("string"))
    return rows.select(*KEY, prepare.encode_regression(rows, "y_value").alias("encoded"))


@query
def unknown_predictions(spark, sf):
    rows = scored(spark, sf)
    classes = prepare.class_table(rows.where(F.col(PERIOD) == REFERENCE), "flag")
    return prepare.unknown_labels(rows.where(F.col(PERIOD) == CURRENT), "flag", classes)


@query
def use_logged_prediction(spark, sf):
    rows = period(spark, sf, CURRENT)
    value, source = prepare.logged_prediction(rows, "pred", "binary", "1")
    return rows.select(*KEY, value.alias("y_pred"), F.lit(source).alias("source"))


@query
def validate_probability(spark, sf):
    rows = scored(spark, sf)
    good = prepare.probability_check(rows, "proba").withColumn("column", F.lit("proba"))
    return good.unionByName(prepare.probability_check(rows, "usage").withColumn("column", F.lit("usage")))


@query
def apply_threshold(spark, sf):
    return scored(spark, sf).select(*KEY, prepare.apply_threshold(F.col("proba"), 0.35).alias("y_pred"))


# --- stand-in model ---------------------------------------------------------------------------


def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_train_holdout(period(spark, sf, REFERENCE), "y_true", KEY).where("part = 'train'")


@query
def impute_median(spark, sf):
    return surrogate.median_values(train_rows(spark, sf), NUMERIC)


@query
def impute_mode(spark, sf):
    rows = train_rows(spark, sf)
    # a value that looks like the label of missing cells, and missing cells
    odd = F.when(F.col("l_linenumber") <= 2, F.lit("(missing)")).when(F.col("l_linenumber") <= 6, F.col("flag"))
    return surrogate.mode_values(rows.withColumn("odd", odd), [*CATEGORICAL, "odd"])


@query
def one_hot(spark, sf):
    """Fitted on the reference; the value only current has gets no slot."""
    from pyspark.ml.functions import vector_to_array

    rows = scored(spark, sf)
    rows = rows.select(PERIOD, as_category(rows, "flag").alias("cat_0"))
    ref = rows.where(F.col(PERIOD) == REFERENCE)
    index = categories.category_index(ref, ["cat_0"])
    coded = index.encoder(spark).transform(index.with_slots(rows))
    labels = F.array(*[F.lit(label) for label in index.listed[0]])
    hot = F.get(labels, F.array_position(vector_to_array("cat_0_onehot"), F.lit(1.0)).cast("int") - 1)
    found = coded.select(PERIOD, F.coalesce(hot, F.lit("(all zeros)")).alias("slot"))
    return found.groupBy(PERIOD, "slot").agg(F.count("*").alias("n"))


@query
def category_slots(spark, sf):
    """Every customer name as a category, numbered by its text; orders of every third customer are not known to the index."""
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("cat_0"))
    orders = table(spark, sf, "orders").join(names, "o_custkey").select("o_orderkey", "cat_0")
    index = categories.category_index(names.where("o_custkey % 3 <> 0"), ["cat_0"])
    index.listed.clear()  # by the joins, whatever the number of values
    return index.with_slots(orders).select("o_orderkey", F.col("cat_0_index").cast("long").alias("slot"))


@query
def class_weights(spark, sf):
    return surrogate.class_weights(train_rows(spark, sf), "tier")


def _score(spark, sf, kind):
    target = {"binary": "y_true", "multiclass": "tier", "regression": "y_value"}[kind]
    ref, cur = period(spark, sf, REFERENCE), period(spark, sf, CURRENT)
    task = columns.infer_task_type(ref, target, kind)
    return surrogate.score_tables(ref, cur, target, task, KEY, NUMERIC, CATEGORICAL)


@query
def fit_classifier(spark, sf):
    """What holds for any forest: the rows and labels of each period, sound outputs, and a lower F1 on current."""
    rows = _score(spark, sf, "binary").rows
    sound = F.col("proba").between(0, 1) & (F.col("y_pred") == (F.col("proba") >= 0.5).cast("int"))
    counts = rows.groupBy(PERIOD).agg(F.count("*").alias("n"), F.sum("y_true").alias("n_positive"), F.sum(sound.cast("long")).alias("n_sound"))
    f1 = performance.binary_metrics(rows).groupBy().agg(*[F.max(F.when(F.col(PERIOD) == p, F.col("f1"))).alias(p) for p in (REFERENCE, CURRENT)])
    return counts.join(F.broadcast(f1.select((F.col(CURRENT) < F.col(REFERENCE)).alias("current_is_worse"))), F.lit(True))


@query
def fit_regressor(spark, sf):
    """What holds for any forest: rows and labels of each period, finite outputs, and a larger error on current."""
    rows = _score(spark, sf, "regression").rows
    sound = F.col("y_pred").isNotNull() & (F.abs("y_pred") < 1e9)
    counts = rows.groupBy(PERIOD).agg(F.count("*").alias("n"), F.avg("y_true").alias("mean_label"), F.sum(sound.cast("long")).alias("n_sound"))
    mae = performance.regression_metrics(rows).groupBy().agg(*[F.max(F.when(F.col(PERIOD) == p, F.col("mae"))).alias(p) for p in (REFERENCE, CURRENT)])
    return counts.join(F.broadcast(mae.select((F.col(CURRENT) > F.col(REFERENCE)).alias("current_is_worse"))), F.lit(True))


@query
def score_tables(spark, sf):
    rows = _score(spark, sf, "multiclass").rows
    total = F.aggregate("probabilities", F.lit(0.0), lambda s, p: s + p)
    sound = F.col("y_pred").between(0, 2) & (F.abs(total - 1.0) < 1e-9)
    return rows.groupBy(PERIOD, "y_true").agg(F.count("*").alias("n"), F.sum(sound.cast("long")).alias("n_sound"))


# --- performance ------------------------------------------------------------------------------


@query
def binary_confusion(spark, sf):
    return performance.binary_confusion(binary_rows(spark, sf))


@query
def confusion_matrix(spark, sf):
    return performance.confusion_matrix(multiclass_rows(spark, sf))


@query
def binary_metrics(spark, sf):
    return performance.binary_metrics(binary_rows(spark, sf))


@query
def roc_auc(spark, sf):
    return performance.roc_auc(binary_rows(spark, sf))


@query
def pr_auc(spark, sf):
    return performance.pr_auc(binary_rows(spark, sf))


def fine_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of which hardly two are equal, as a model gives them."""
    fine = F.col("proba") + ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100003).cast("double") / F.lit(1e7)
    return scored(spark, sf).select(PERIOD, "y_true", fine.alias("proba"))


@query
def ranked_metrics_fine(spark, sf):
    return performance.ranked_metrics(fine_rows(spark, sf))


@query
def multiclass_metrics(spark, sf):
    return performance.multiclass_metrics(multiclass_rows(spark, sf))


@query
def log_loss(spark, sf):
    return performance.log_loss(multiclass_rows(spark, sf), TIERS)


@query
def regression_metrics(spark, sf):
    return performance.regression_metrics(regression_rows(spark, sf))


@query
def residuals(spark, sf):
    rows = scored(spark, sf).select(*KEY, F.col("y_value").alias("y_true"), F.col("pred_value").alias("y_pred"))
    return performance.residuals(rows)


@query
def performance_table(spark, sf):
    return performance_of(spark, sf, "multiclass")


@query
def roc_curve(spark, sf):
    return performance.roc_curve(binary_rows(spark, sf))


@query
def pr_curve(spark, sf):
    return performance.pr_curve(binary_rows(spark, sf))


# --- calibration ------------------------------------------------------------------------------


@query
def calibration_curve(spark, sf):
    return calibration.calibration_curve(binary_rows(spark, sf))


@query
def brier_score(spark, sf):
    return calibration.brier_score(binary_rows(spark, sf))


@query
def calibration_assessment(spark, sf):
    return calibration_of(spark, sf)


# --- segments ---------------------------------------------------------------------------------


@query
def segment_columns(spark, sf):
    half = F.when(F.col("c_custkey") % 2 == 0, REFERENCE).otherwise(CURRENT)
    customers = table(spark, sf, "customer").withColumn(PERIOD, half)
    names = ["c_name", "c_mktsegment"]
    return segments.segment_columns(pair_from(customers, names), names)


@query
def segments_binary(spark, sf):
    return segments_of(spark, sf, "binary")


@query
def segments_multiclass(spark, sf):
    return segments_of(spark, sf, "multiclass")


@query
def segments_regression(spark, sf):
    return segments_of(spark, sf, "regression")


@query
def weak_segments(spark, sf):
    return report.weak_current(segments_of(spark, sf)).select("segment_column", "segment_group", "n", "status")


# --- thresholds -------------------------------------------------------------------------------


@query
def threshold_sweep(spark, sf):
    return sweep_of(spark, sf)


@query
def best_threshold(spark, sf):
    return threshold.best_threshold(sweep_of(spark, sf))


@query
def threshold_improvement(spark, sf):
    return threshold.threshold_improvement(sweep_of(spark, sf), 0.50)


# --- health -----------------------------------------------------------------------------------


@query
def health_quality(spark, sf):
    return health.health_quality(quality_of(spark, sf))


@query
def health_stability(spark, sf):
    return health.health_stability(drift_of(spark, sf))


@query
def health_performance_binary(spark, sf):
    return health.health_performance_binary(performance_of(spark, sf, "binary"))


@query
def health_performance_multiclass(spark, sf):
    return health.health_performance_multiclass(performance_of(spark, sf, "multiclass"))


@query
def health_performance_regression(spark, sf):
    return health.health_performance_regression(performance_of(spark, sf, "regression"))


@query
def health_reliability(spark, sf):
    return health.health_reliability(calibration_of(spark, sf))


@query
def health_segments(spark, sf):
    return health.health_segments(segments_of(spark, sf))


@query
def health_score(spark, sf):
    return analysis_of(spark, sf).score


@query
def health_components(spark, sf):
    return analysis_of(spark, sf).components


# --- report -----------------------------------------------------------------------------------


@query
def finding_drift(spark, sf):
    return report.finding_drift(drift_of(spark, sf))


@query
def finding_performance(spark, sf):
    return report.finding_performance(performance_of(spark, sf, "regression"), "regression")


@query
def finding_calibration(spark, sf):
    return report.finding_calibration(calibration_of(spark, sf))


@query
def finding_segment(spark, sf):
    return report.finding_segment(segments_of(spark, sf, "regression"), "regression")


def _settled_parts(spark, sf):
    return (
        literal_table(drift_of(spark, sf)),
        literal_table(performance_of(spark, sf, "binary")),
        literal_table(calibration_of(spark, sf)),
        literal_table(segments_of(spark, sf)),
    )


@query
def findings(spark, sf):
    return report.findings(*_settled_parts(spark, sf), "binary")


@query
def actions(spark, sf):
    drifted, compared, calibrated, _ = _settled_parts(spark, sf)
    return report.actions(drifted, compared, calibrated, literal_table(sweep_of(spark, sf)), "binary", 0.50)


@query
def limitations(spark, sf):
    rows = scored(spark, sf)
    n = rows.where(F.col(PERIOD) == CURRENT).count()
    return report.limitations(segments_of(spark, sf, "multiclass"), "multiclass", n, True, spark)


@query
def report_summary(spark, sf):
    return analysis_of(spark, sf, "regression").summary()


@query
def headline_counts(spark, sf):
    return analysis_of(spark, sf).headline


@query
def json_top_drift(spark, sf):
    return report.top_drift(drift_of(spark, sf)).select("column", "kind", "measure", "score", "status")


@query
def json_health(spark, sf):
    return analysis_of(spark, sf, "multiclass").score


@query
def json_performance(spark, sf):
    return performance_of(spark, sf, "binary")


@query
def json_calibration(spark, sf):
    return calibration_of(spark, sf)


@query
def json_segments(spark, sf):
    return report.current_segments(segments_of(spark, sf))


@query
def json_thresholds(spark, sf):
    return report.top_thresholds(sweep_of(spark, sf))


# --- chart tables -----------------------------------------------------------------------------


@query
def severity_counts(spark, sf):
    return charts.severity_counts(report.findings(*_settled_parts(spark, sf), "binary"))


def wide_pair(spark: SparkSession, sf: str) -> Pair:
    """More columns than any chart shows: those of the log, and copies of its numbers that lack more and more values."""
    rows = scored(spark, sf).drop("l_shipdate")
    late = F.col(PERIOD) == CURRENT
    copies = [F.when(~late | (F.col("l_orderkey") % (i + 3) != 0), F.col(c) + i).alias(f"{c}_{i}") for i, c in enumerate(WIDE)]
    return pair_from(rows.select("*", *copies))


WIDE = ["usage", "amount", "y_value", "pred_value", "usage", "amount"]


def wide_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_table(wide_pair(spark, sf), "y_true")


@query
def missing_top(spark, sf):
    return charts.missing_top(wide_quality(spark, sf))


@query
def quality_status_counts(spark, sf):
    return charts.quality_status_counts(quality_of(spark, sf))


@query
def distinct_change_top(spark, sf):
    return charts.distinct_change_top(wide_quality(spark, sf))


@query
def class_shares(spark, sf):
    return charts.class_shares(scored(spark, sf), "tier")


@query
def drift_top(spark, sf):
    pair = wide_pair(spark, sf)
    numeric, categorical = columns.feature_columns(pair, "y_true", ["l_orderkey", "l_linenumber"])
    return charts.drift_top(drift.drift_table(pair, numeric, categorical))


@query
def drift_scores(spark, sf):
    return charts.drift_scores(drift_of(spark, sf))


@query
def numeric_histogram(spark, sf):
    return charts.numeric_histogram(plain_pair(spark, sf), "amount")


@query
def numeric_box(spark, sf):
    return charts.numeric_box(plain_pair(spark, sf), "amount")


@query
def category_top_shares(spark, sf):
    half = F.when(F.col("p_partkey") % 2 == 0, REFERENCE).otherwise(CURRENT)
    parts = table(spark, sf, "part").withColumn(PERIOD, half)
    return charts.category_top_shares(pair_from(parts, ["p_brand"]), "p_brand")


@query
def performance_long(spark, sf):
    return charts.performance_long(performance_of(spark, sf, "binary"))


@query
def confusion_pivot(spark, sf):
    return charts.confusion_pivot(performance.confusion_matrix(multiclass_rows(spark, sf)), TIERS)


@query
def probability_histogram(spark, sf):
    return charts.probability_histogram(binary_rows(spark, sf))


@query
def box_extremes(spark, sf):
    rows = scored(spark, sf)
    return charts.box_extremes(pair_from(rows, [*KEY, "amount"]), "amount", KEY, 20)


@query
def scatter_points(spark, sf):
    rows = scored(spark, sf).select(PERIOD, *KEY, F.col("y_value").alias("y_true"), F.col("pred_value").alias("y_pred"))
    return charts.scatter_points(rows, KEY, 500)


@query
def scatter_grid(spark, sf):
    return charts.scatter_grid(regression_rows(spark, sf), 50)


@query
def histogram_with_infinities(spark, sf):
    rows = scored(spark, sf)
    endless = F.when(F.col("l_orderkey") % 100 == 0, F.lit(float("inf"))).when(F.col("l_orderkey") % 100 == 1, F.lit(float("-inf")))
    return charts.numeric_histogram(pair_from(rows.withColumn("amount", F.coalesce(endless, F.col("amount"))), ["amount"]), "amount")


@query
def scatter_bounds(spark, sf):
    return charts.scatter_bounds(regression_rows(spark, sf))


@query
def residual_histogram(spark, sf):
    return charts.residual_histogram(regression_rows(spark, sf))


@query
def segment_metrics_long(spark, sf):
    return charts.segment_metrics_long(segments_of(spark, sf), "flag", "binary")


@query
def segment_matrix(spark, sf):
    return charts.segment_matrix(segments_of(spark, sf, "multiclass"), "flag", "multiclass")


@query
def threshold_long(spark, sf):
    return charts.threshold_long(sweep_of(spark, sf))


@query
def component_scores(spark, sf):
    return charts.component_scores(analysis_of(spark, sf, "multiclass").components)


# --- composed ---------------------------------------------------------------------------------


@query
def full_analysis_binary(spark, sf):
    return analysis_of(spark, sf, "binary").overview()


@query
def full_analysis_multiclass(spark, sf):
    return analysis_of(spark, sf, "multiclass").overview()


@query
def full_analysis_regression(spark, sf):
    return analysis_of(spark, sf, "regression").overview()


@query
def full_analysis_fitted(spark, sf):
    """Two tables in, with the stand-in model fitted on the first: the sections that do not depend on its trees."""
    ref = period(spark, sf, REFERENCE).select(*KEY, *NUMERIC, *CATEGORICAL, "y_true")
    cur = period(spark, sf, CURRENT).select(*KEY, *NUMERIC, *CATEGORICAL, "y_true")
    overview = analyze(ref, cur, "y_true", KEY, positive="1", excluded=KEY).overview()
    return overview.where("section IN ('quality', 'drift') OR item = 'stability'")


def logged_overview(result) -> DataFrame:
    """The sections of a logged run on current that do not depend on the model's holdout."""
    own = "(section = 'performance' AND measure = 'after') OR (section = 'segment' AND item LIKE 'current/%')"
    return result.overview().where(f"section IN ('quality', 'drift', 'threshold') OR item = 'stability' OR {own}")


LOGGED = {"binary": ("y_true", "pred", "proba"), "multiclass": ("tier", "pred_tier", None), "regression": ("y_value", "pred_value", None)}


def logged_of(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Two raw tables with logged outputs in the current one."""
    target, prediction, probability = LOGGED[kind]
    outputs = [c for c in (prediction, probability) if c]
    ref = period(spark, sf, REFERENCE).select(*KEY, *NUMERIC, *CATEGORICAL, target)
    cur = period(spark, sf, CURRENT).select(*KEY, *NUMERIC, *CATEGORICAL, target, *outputs)
    positive = "1" if kind == "binary" else None
    return logged_overview(
        analyze(ref, cur, target, KEY, kind, positive, [*KEY, *outputs], prediction_column=prediction, probability_column=probability)
    )


@query
def full_analysis_logged_binary(spark, sf):
    return logged_of(spark, sf, "binary")


def logged_scored(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Logged outputs of both periods, without a stand-in model."""
    target, prediction, _ = LOGGED[kind]
    rows = scored(spark, sf)
    outputs = prepare.scored_table(rows, kind, target, prediction, keep=CATEGORICAL)
    return analyze_scored(outputs, pair_from(rows, [*NUMERIC, *CATEGORICAL, target]), kind, NUMERIC, CATEGORICAL, target).overview()


@query
def full_analysis_logged_multiclass(spark, sf):
    return logged_scored(spark, sf, "multiclass")


@query
def full_analysis_logged_regression(spark, sf):
    return logged_scored(spark, sf, "regression")


@query
def full_analysis_unlabelled(spark, sf):
    """Current has probabilities but no labels: quality, drift, and no word on performance."""
    rows = binary_rows(spark, sf)
    rows = rows.withColumn("y_true", F.when(F.col(PERIOD) == REFERENCE, F.col("y_true")))
    result = analyze_scored(rows, pair_from(scored(spark, sf), [*NUMERIC, *CATEGORICAL]), "binary", NUMERIC, CATEGORICAL)
    nothing = [result.performance, result.calibration, result.segments, result.sweep, result.roc_curve(), result.pr_curve(), result.calibration_curve()]
    sections = result.overview().where("section IN ('quality', 'drift')")
    return sections.withColumn("n_results", F.lit(sum(x is not None for x in nothing)))


@query
def full_analysis_single_table(spark, sf):
    """One table, split by time, then compared."""
    labelled, _ = split.split_periods(scored(spark, sf).drop(PERIOD), KEY, 0.6, "l_shipdate")
    outputs = prepare.scored_table(labelled, "binary", "y_true", "pred", "proba", "1", keep=CATEGORICAL)
    pair = pair_from(labelled, [*NUMERIC, *CATEGORICAL, "y_true"])
    return analyze_scored(outputs, pair, "binary", NUMERIC, CATEGORICAL, "y_true").overview()


@query
def analysis_profile(spark, sf):
    """The profile of both sides, from the composed result."""
    result = analysis_of(spark, sf)
    found = None
    for name in (REFERENCE, CURRENT):
        parts = result.profile(name)
        row = parts["summary"].select(F.lit(name).alias(PERIOD), "n_rows", "n_columns", "missing_cells")
        row = row.join(F.broadcast(parts["duplicates"].select("duplicate_rows")), F.lit(True))
        row = row.join(F.broadcast(parts["target"].agg(F.sum(F.when(F.col("value") == "1", F.col("n"))).alias("n_positive"))), F.lit(True))
        found = row if found is None else found.unionByName(row)
    return found


@query
def json_text(spark, sf):
    """The JSON records themselves, read back: one row for each row of the score and of the performance table."""
    text = analysis_of(spark, sf).json()
    record = F.from_json("records", "ARRAY<STRUCT<metric: STRING, before: DOUBLE, after: DOUBLE, score: DOUBLE, risk: STRING>>")
    return text.where("view IN ('performance', 'health')").select("view", "n", F.explode(record).alias("r")).select("view", "n", "r.*")
