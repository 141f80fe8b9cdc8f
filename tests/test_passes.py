"""How often the composed analysis reads its input."""

import math
import threading

import pytest
from pyspark.sql import functions as F

from pulsecheck import analyze_scored, pair_from
from pulsecheck.functions.literal import literal_table
from pulsecheck.operators import calibration, cells, performance, segments, threshold
from pulsecheck.plans import analysis
from workload.fixture import CATEGORICAL, NUMERIC, scored, table
from workload.queries import binary_rows


def records_read(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def test_full_analysis_reads_its_input_six_times(spark):
    sf = "/root/testdata/sf0.01"
    n = table(spark, sf, "lineitem").count()
    before = records_read(spark)
    pair = pair_from(scored(spark, sf), [*NUMERIC, *CATEGORICAL, "y_true"])
    analyze_scored(binary_rows(spark, sf), pair, "binary", NUMERIC, CATEGORICAL, "y_true").overview().collect()
    assert 0 < (records_read(spark) - before) / n <= 6.5  # the tables in the shared folder count too


@pytest.fixture(scope="module")
def odd(spark):
    """Probabilities at both ends, missing ones, missing labels, and a column with too many groups in one period."""
    rows = []
    for i in range(2400):
        p = [0.0, 1.0, 1e-9, 1 - 1e-9, 0.5, 0.1, 0.9, math.nan, None, (i % 1009) / 1009][i % 10]
        label = None if i % 37 == 0 and i < 1200 else int((i * 7) % 10 < 4 + 4 * (p is not None and p > 0.5))
        rows.append(("reference" if i < 1200 else "current", f"g{i % 3}" if i % 5 else None, f"h{i % (40 if i < 1200 else 4)}", label, int(i % 4 == 0), p))
    return spark.createDataFrame(rows, "period string, g string, h string, y_true int, y_pred int, proba double").repartition(3)


def rounded(df, *order):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).fillna(-9.0).fillna("-").collect())


def test_cells_give_the_same_results(odd):
    pair = pair_from(odd.select("period", "g", "h"))
    kept = [tuple(r) for r in segments.segment_columns(pair, ["g", "h"]).where("kept").select("period", "segment_column").collect()]
    assert sorted(kept) == [("current", "g"), ("current", "h"), ("reference", "g")]
    found = cells.score_cells(odd, kept)
    labelled = odd.where("y_true IS NOT NULL")
    assert rounded(cells.cell_metrics(found, labelled)) == rounded(literal_table(performance.task_metrics(labelled, "binary")))
    assert rounded(cells.cell_segments(found, 30)) == rounded(segments.weak_segments(odd, pair, ["g", "h"], "binary"))
    assert rounded(cells.cell_assessment(found)) == rounded(calibration.calibration_assessment(odd))
    assert rounded(cells.cell_sweep(found)) == rounded(threshold.threshold_sweep(odd))


def test_cuts_come_from_the_cells_or_from_a_draw(spark, odd):
    found = cells.cell_cuts(cells.score_cells(odd), odd).collect()
    assert {r["period"] for r in found} == {"reference", "current"} and all(r["cuts"] == sorted(r["cuts"]) for r in found)
    close = odd.withColumn("proba", F.lit(0.5) + F.rand(3) / 1e6)
    drawn = cells.cell_cuts(cells.score_cells(close), close).collect()
    assert all(0.5 <= c <= 0.500001 for r in drawn for c in r["cuts"])


def test_kept_segments_as_judged_by_counts(odd):
    from pulsecheck.operators.frequency import column_stats

    pair = pair_from(odd.select("period", "g", "h"))
    assert cells.kept_segments(column_stats(pair, ["g", "h"]), ["g", "h"]) == [("current", "g"), ("current", "h"), ("reference", "g")]


def test_pair_is_counted_once_and_beside_the_fit(spark, monkeypatch):
    counted, count, score = [], analysis.column_stats, analysis.surrogate.score_tables
    begun = threading.Event()

    def watched(pair, columns, textual):
        begun.set()
        counted.append(columns)
        return count(pair, columns, textual)

    def fitted(*a, **k):
        assert begun.wait(60)
        return score(*a, **k)

    monkeypatch.setattr(analysis, "column_stats", lambda pair, columns, textual=None: watched(pair, columns, textual) if columns is None else count(pair, columns))
    monkeypatch.setattr(analysis.surrogate, "score_tables", fitted)
    rows = spark.range(400).selectExpr("id", "cast(id * 37 % 101 as double) AS x", "concat('k', id % 3) AS kind", "cast(id * 37 % 101 > 50 as int) AS y")
    result = analysis.analyze(rows, rows, "y", ["id"], positive="1", excluded=["id"], trees=2)
    assert counted == [None] and {r["column"] for r in result.drift.collect()} == {"x", "kind"}
