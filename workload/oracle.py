"""The same results in DuckDB SQL, written independently of the Spark plans.

`PARTS` holds named sub-queries; `sql` puts those that a statement uses in front of it.
"""

from __future__ import annotations

import re

from workload.fixture import CATEGORICAL, NUMERIC, SCORED

FEATURES = [*NUMERIC, *CATEGORICAL]
QUALITY = [*FEATURES, "y_true"]
PARTS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def part(name: str, text: str) -> None:
    PARTS[name] = text


def sql(text: str) -> str:
    """`text` with all sub-queries it needs, each after those it needs itself."""
    ordered: list[str] = []
    seen: set[str] = set()

    def need(body: str) -> None:
        for name in PARTS:
            if name not in seen and re.search(rf"\b{name}\b", body):
                seen.add(name)
                need(PARTS[name])
                ordered.append(name)

    need(text)
    # What the steps of a walk read is worked out once.
    chain = ",\n".join(f"{n} AS {'MATERIALIZED ' if n.endswith('ks_small') else ''}({PARTS[n]})" for n in ordered)
    return f"WITH RECURSIVE {chain}\n{text}" if ordered else text


def oracle(name: str, text: str) -> None:
    ORACLE[name] = sql(text)


def r6(expression: str, name: str | None = None) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name or expression}"


def n(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression}"


def div(top: str, bottom: str) -> str:
    return f"(CASE WHEN ({bottom}) = 0 THEN 0.0::DOUBLE ELSE CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE) END)"


def union(texts: list[str]) -> str:
    return "\nUNION ALL\n".join(texts)


REF, CUR = "period = 'reference'", "period = 'current'"

part("scored", SCORED.format(lineitem="lineitem"))
part("refrows", f"SELECT * FROM scored WHERE {REF}")
part("currows", f"SELECT * FROM scored WHERE {CUR}")

# --- sources, splits ----------------------------------------------------------------------------

oracle(
    "scan_csv",
    "SELECT o_orderkey, o_custkey, o_orderstatus, " + r6("o_totalprice") + ", CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders",
)
oracle("csv_documents", "SELECT doc_id, md5(text) AS md5, lang, source, n_chars FROM documents")
ODD_LINE = '''concat(CAST(o_orderkey + 1234567890000000000 AS VARCHAR), ',', o_orderkey % 97, '" pipe,"', o_orderstatus, ',""x""",a', CASE WHEN o_orderkey % 50 = 0 THEN ',b' ELSE '' END)'''
oracle(
    "csv_large_ids",
    """SELECT o_orderkey + 1234567890000000000 AS id, concat(o_orderkey % 97, '" pipe') AS size, concat(o_orderstatus, ',"x"') AS status, 'a' AS last
       FROM orders WHERE o_orderkey % 50 <> 0""",
)
oracle("csv_broken_rows", f"SELECT CAST(5 AS BIGINT) AS n_fields, {ODD_LINE} AS record FROM orders WHERE o_orderkey % 50 = 0")
oracle(
    "split_by_time_text",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey)
       <= CAST(floor(count(*) OVER () * 0.6) AS BIGINT) THEN 'reference' ELSE 'current' END AS period FROM orders""",
)
WAYS = {
    "MM/dd/yyyy": "month/day/year", "dd/MM/yyyy": "day/month/year", "yyyy/MM/dd": "year/month/day", "dd.MM.yyyy": "day.month.year",
    "yyyyMMdd": "yearmonthday", "MMM dd, yyyy": "name day, year", "yyyy-MM-dd HH:mm:ss": "iso",
}
oracle(
    "time_ways",
    union([f"SELECT '{p}' AS pattern, count(*) AS n_rows, count(*) AS n_parsed, true AS accepted, '{w}' AS written, false AS ambiguous FROM orders" for p, w in WAYS.items()]),
)
oracle(
    "split_by_instant",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts NULLS LAST, event_id)
       <= CAST(floor(count(*) OVER () * 0.45) AS BIGINT) THEN 'reference' ELSE 'current' END AS period FROM events""",
)
oracle(
    "scan_two_tables",
    f"""SELECT period, count(*) AS n, {r6('sum(usage)', 'usage')}, count(pred) AS n_pred,
    count(y_value) FILTER ({REF}) AS n_y_value, count(pred_value) FILTER ({CUR}) AS n_pred_value FROM scored GROUP BY period""",
)
oracle(
    "split_by_time",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts NULLS LAST, event_id)
       <= CAST(floor(count(*) OVER () * 0.6) AS BIGINT) THEN 'reference' ELSE 'current' END AS period FROM events""",
)
oracle(
    "time_parse_share",
    f"""SELECT count(*) AS n_rows, count(*) FILTER (event_type <> 'error') AS n_parsed,
    {r6("avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END)", 'share')},
    avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) >= 0.8 AS accepted FROM events""",
)
oracle(
    "split_by_order",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey)
       <= CAST(floor(count(*) OVER () * 0.75) AS BIGINT) THEN 'reference' ELSE 'current' END AS period FROM orders""",
)
oracle(
    "split_train_holdout",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE WHEN row_number() OVER (ORDER BY l_orderkey, l_linenumber) <= floor(count(*) OVER () * 0.8)
       THEN 'train' ELSE 'holdout' END AS part FROM refrows WHERE discount IS NOT NULL""",
)
oracle(
    "labels_complete",
    union(
        [
            f"SELECT '{c}' AS target, count(*) AS n_rows, count({c}) AS n_labelled, count(*) = count({c}) AS complete FROM scored"
            for c in ("y_true", "discount", "tier")
        ]
    ),
)

# --- columns ------------------------------------------------------------------------------------

oracle(
    "feature_columns",
    union(
        [
            f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS ref_values FROM refrows"
            for c, k in (("usage", "numeric"), ("discount", "numeric"), ("flag", "categorical"))
        ]
    ),
)
oracle(
    "infer_task_type",
    union(
        [
            f"""SELECT '{t}.{c}' AS target, n_values, n_distinct, CASE WHEN n_distinct < 2 THEN NULL
            WHEN n_distinct = 2 THEN 'binary' WHEN n_distinct > greatest(20, floor(n_values * 0.05)) THEN 'regression'
            ELSE 'multiclass' END AS kind FROM (SELECT count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM {t})"""
            for t, c in (("labels", "quality"), ("embeddings", "label"), ("orders", "o_totalprice"))
        ]
    ),
)
oracle(
    "class_list",
    """SELECT class, row_number() OVER (ORDER BY class) - 1 AS class_index, class = max(class) OVER () AS is_default_positive
       FROM (SELECT DISTINCT CAST(label AS VARCHAR) AS class FROM embeddings WHERE label IS NOT NULL)""",
)


def column_facts(table: str, names: list[str], numeric: list[str], times: list[str] = ()) -> str:
    return union(
        [
            f"""SELECT '{c}' AS "column", {i} AS position, {str(c in numeric).lower()} AS is_num,
            {str(c in times).lower()} AS is_time, count(*) AS n_rows, count(*) - count({c}) AS n_missing,
            count(DISTINCT {c}) AS n_distinct FROM {table}"""
            for i, c in enumerate(names)
        ]
    )


TARGET_HINT = "regexp_matches(lower(\"column\"), 'target|label|y_true|outcome|failure|fraud|churn|defect|price|score')"
ID_RULE = """n_rows > n_missing AND (is_time OR (NOT is_num AND n_distinct / greatest(n_rows, 1) >= 0.95)
    OR (regexp_matches(lower("column"), 'id|uuid|key|index|timestamp|datetime') AND n_distinct / greatest(n_rows, 1) >= 0.5))"""
CONSTANT_RULE = "n_distinct + CASE WHEN n_missing > 0 THEN 1 ELSE 0 END <= 1"
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
LOG = [
    "l_linenumber", "l_shipdate", "period", "usage", "amount", "discount", "tax", "flag", "line_status",
    "y_true", "proba", "pred", "tier", "pred_tier", "y_value", "pred_value",
]
LOG_NUMBERS = [c for c in LOG if c not in ("l_shipdate", "period", "flag", "line_status", "tier", "pred_tier")]

oracle(
    "target_candidates",
    f"SELECT \"column\", {TARGET_HINT} AS hint, n_distinct FROM ({column_facts('orders', ORDERS, [])})",
)
oracle(
    "id_candidates",
    f"""SELECT {n('position')}, "column", n_distinct, n_rows
    FROM ({column_facts('customer', CUSTOMER, ['c_custkey', 'c_nationkey', 'c_acctbal'])}) WHERE {ID_RULE}""",
)
part("withnothing", "SELECT *, NULL::DOUBLE AS nothing FROM refrows")
oracle(
    "constant_columns",
    f"""SELECT {n('position')}, "column", n_distinct, n_missing
    FROM ({column_facts('withnothing', ['l_orderkey', *LOG, 'nothing'], [])}) WHERE {CONSTANT_RULE}""",
)
part("keyed", "SELECT *, l_orderkey || '-' || l_linenumber AS row_key FROM refrows")
# in the keyed table l_orderkey is dropped and row_key comes last
part(
    "keyedfacts",
    column_facts("keyed", [*LOG, "row_key"], LOG_NUMBERS, ["l_shipdate"]),
)
oracle(
    "suggested_exclusions",
    f"""SELECT "column", {n('min(rank)', 'rank')}, arg_min(reason, rank) AS reason FROM (
      SELECT "column", position AS rank, 'id' AS reason FROM keyedfacts WHERE "column" <> 'y_true' AND {ID_RULE}
      UNION ALL SELECT "column", position + 1000000, 'constant' FROM keyedfacts WHERE "column" <> 'y_true' AND {CONSTANT_RULE}
      UNION ALL SELECT 'pred', 2000000, 'logged_output' UNION ALL SELECT 'proba', 2000001, 'logged_output') GROUP BY 1""",
)

# --- profile ------------------------------------------------------------------------------------

oracle(
    "profile_summary",
    f"""SELECT count(*) AS n_rows, {n('17', 'n_columns')}, {n('11', 'n_numeric')}, {n('6', 'n_categorical')},
    CAST(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in ['l_orderkey', *LOG])}) AS BIGINT) AS missing_cells
    FROM scored""",
)
oracle(
    "duplicate_rows",
    f"SELECT count(*) AS n_rows, {n('count(*) - count(DISTINCT text)', 'duplicate_rows')} FROM documents",
)
oracle(
    "duplicate_whole_rows",
    f"""SELECT {n('sum(c)', 'n_rows')}, {n('sum(c - 1)', 'duplicate_rows')} FROM (SELECT count(*) AS c FROM lineitem
    GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount, l_tax)""",
)
part(
    "leaky",
    """SELECT doc_id, toxic, quality, CAST(quality AS VARCHAR) AS copied, quality * 2 + 1 AS shifted,
       CASE WHEN doc_id % 4 <> 0 THEN quality END AS partial FROM labels""",
)
oracle(
    "leakage_equality",
    "SELECT * FROM ("
    + union(
        [
            f"""SELECT '{c}' AS "column", 'equality' AS reason,
            {r6(f"avg(CASE WHEN CAST({c} AS VARCHAR) = CAST(quality AS VARCHAR) THEN 1.0 ELSE 0.0 END)", 'strength')}
            FROM leaky WHERE {c} IS NOT NULL AND quality IS NOT NULL HAVING count(*) >= 30"""
            for c in ("doc_id", "toxic", "copied", "shifted", "partial")
        ]
    )
    + ") WHERE strength >= 0.98",
)
oracle(
    "leakage_correlation",
    union(
        [
            f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NOT NULL AND quality IS NOT NULL) AS n_comparable,
            {r6(f"abs(corr({c}, quality))" if c != 'copied' else 'NULL', 'strength')} FROM leaky"""
            for c in ("doc_id", "toxic", "copied", "shifted", "partial")
        ]
    ),
)
oracle(
    "target_distribution",
    "SELECT coalesce(CAST(tax AS VARCHAR), '(missing)') AS value, count(*) AS n FROM scored GROUP BY 1",
)

# --- quality ------------------------------------------------------------------------------------


def quality_facts(names: list[str], target: str, table: str = "scored") -> str:
    rows = []
    for i, c in enumerate(names):
        text = c in (*CATEGORICAL, "tier", "pred_tier")
        kind = "string" if text else "bigint" if c == "l_orderkey" else "int" if c in ("y_true", "pred", "l_linenumber") else "double"
        new = (
            f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM {table} WHERE {CUR} AND {c} IS NOT NULL EXCEPT SELECT {c} FROM {table} WHERE {REF}))"
            if text
            else "0"
        )
        rows.append(
            f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS ref_type, '{kind}' AS cur_type,
            avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FILTER ({REF}) AS ref_missing_rate,
            avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FILTER ({CUR}) AS cur_missing_rate,
            count(DISTINCT {c}) FILTER ({REF}) AS ref_distinct, count(DISTINCT {c}) FILTER ({CUR}) AS cur_distinct,
            {new} AS found_new, count(*) FILTER ({REF}) AS ref_rows, {str(c == target).lower()} AS is_target FROM {table}"""
        )
    return f"""SELECT *, CASE WHEN missing_delta >= 0.10 THEN 'missing_up_10_points'
      WHEN new_categories > 0 OR missing_delta >= 0.03 THEN 'new_category_or_missing_up' ELSE 'none' END AS reason,
      CASE WHEN missing_delta >= 0.10 THEN 'danger' WHEN new_categories > 0 OR missing_delta >= 0.03 THEN 'warning'
      ELSE 'stable' END AS status
    FROM (SELECT *, cur_missing_rate - ref_missing_rate AS missing_delta,
      CASE WHEN ref_distinct <= least(100, greatest(20, floor(ref_rows * 0.20))) THEN found_new ELSE 0 END AS new_categories
      FROM ({union(rows)}))"""


part("quality_rows", quality_facts(QUALITY, "y_true"))
part("quality_tier", quality_facts([*FEATURES, "tier"], "tier"))
part("quality_value", quality_facts([*FEATURES, "y_value"], "y_value"))
WIDE = ["usage", "amount", "y_value", "pred_value", "usage", "amount"]
COPIES = [f"{c}_{i}" for i, c in enumerate(WIDE)]
part(
    "wide_log",
    "SELECT *, "
    + ", ".join(f"CASE WHEN {REF} OR l_orderkey % {i + 3} <> 0 THEN {c} + {i} END AS {c}_{i}" for i, c in enumerate(WIDE))
    + " FROM scored",
)
WIDE_COLUMNS = [
    "l_orderkey", "l_linenumber", *FEATURES, "y_true", "proba", "pred", "tier", "pred_tier", "y_value", "pred_value", *COPIES,
]
part("quality_wide", quality_facts(WIDE_COLUMNS, "y_true", "wide_log"))
oracle(
    "missing_rates",
    f"SELECT \"column\", {r6('ref_missing_rate')}, {r6('cur_missing_rate')}, {r6('missing_delta')} FROM quality_rows",
)
oracle("distinct_counts", 'SELECT "column", ref_distinct, cur_distinct FROM quality_rows')
#: Of the two uneven tables: types as DuckDB has them in either table, cells and missing cells.
part("uneven_ref", f"SELECT usage, discount, flag, pred, y_value FROM scored WHERE {REF}")
part("uneven_cur", f"SELECT usage, discount, flag, CAST(pred AS VARCHAR) AS pred, pred_value FROM scored WHERE {CUR}")


def _uneven(c: str) -> str:
    """Facts of one column of either side; the type of a side without it is null."""
    spark_type = "CASE {0} WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' END"
    sides = []
    for name, table in (("ref", "uneven_ref"), ("cur", "uneven_cur")):
        has = c not in (("pred_value",) if name == "ref" else ("y_value",))
        kind = spark_type.format(f"(SELECT any_value(typeof({c})) FROM {table})") if has else "NULL::VARCHAR"
        missing = f"(SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM {table})" if has else "NULL::DOUBLE"
        sides.append(f"{kind} AS {name}_type, {missing} AS {name}_missing, (SELECT count(*) FROM {table}) AS {name}_rows")
    both = c not in ("y_value", "pred_value")
    new = f"(SELECT count(*) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) FROM uneven_cur EXCEPT SELECT CAST({c} AS VARCHAR) FROM uneven_ref))" if both else "0"
    return f"""SELECT '{c}' AS "column", {', '.join(sides)}, {new} AS found_new"""


part("uneven_facts", union([_uneven(c) for c in ("usage", "discount", "flag", "pred", "y_value", "pred_value")]))
oracle(
    "type_changes",
    f"""SELECT "column", ref_type, cur_type, ref_type <> cur_type AS type_changed, ref_rows, cur_rows FROM uneven_facts
    WHERE ref_type IS NOT NULL AND cur_type IS NOT NULL""",
)
oracle("new_categories", f'SELECT "column", {n("new_categories")} FROM quality_rows')
oracle(
    "missing_columns",
    f"""SELECT 'y_value' AS "column", 'reference' AS present_in, count(y_value) FILTER ({REF}) AS n_values FROM scored
    UNION ALL SELECT 'pred_value', 'current', count(pred_value) FILTER ({CUR}) FROM scored""",
)
oracle(
    "quality_status",
    """SELECT "column", CASE WHEN reason IN ('one_sided', 'type_changed', 'missing_up_10_points') THEN 'danger'
      WHEN reason = 'none' THEN 'stable' ELSE 'warning' END AS status, reason FROM (
      SELECT "column", CASE WHEN ref_type IS NULL OR cur_type IS NULL THEN 'one_sided' WHEN ref_type <> cur_type THEN 'type_changed'
        WHEN cur_missing - ref_missing >= 0.10 THEN 'missing_up_10_points'
        WHEN cur_missing - ref_missing >= 0.03 OR (ref_type = 'string' AND found_new > 0) THEN 'new_category_or_missing_up'
        ELSE 'none' END AS reason FROM uneven_facts)""",
)
oracle(
    "quality_table",
    f"""SELECT {n('position')}, "column", ref_type, cur_type, {r6('ref_missing_rate')}, {r6('cur_missing_rate')},
    {r6('missing_delta')}, ref_distinct, cur_distinct, {n('new_categories')}, reason, status, is_target FROM quality_rows""",
)
oracle(
    "sink_csv_roundtrip",
    f"""SELECT {n('position')}, "column", ref_type, cur_type, {r6('ref_missing_rate')}, {r6('cur_missing_rate')},
    {r6('missing_delta')}, ref_distinct, cur_distinct, {n('new_categories')}, reason, status, is_target FROM quality_rows""",
)

# --- drift --------------------------------------------------------------------------------------

part(
    "num_cells",
    union([f"SELECT '{c}' AS col, period, {c} AS value FROM scored WHERE {c} IS NOT NULL" for c in NUMERIC]),
)
part(
    "num_stats",
    f"""SELECT col, count(*) FILTER ({REF}) AS ref_n, count(*) FILTER ({CUR}) AS cur_n,
    avg(value) FILTER ({REF}) AS ref_mean, avg(value) FILTER ({CUR}) AS cur_mean FROM num_cells GROUP BY col""",
)
part("ref_sorted", f"SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS rk FROM num_cells WHERE {REF}")
part(
    "edge_places",
    """SELECT col, i, h, floor(h) AS lo, least(floor(h) + 1, ref_n - 1) AS hi FROM (
       SELECT col, i, ref_n, CAST(ref_n - 1 AS DOUBLE) * CASE WHEN i = 10 THEN 1.0::DOUBLE ELSE CAST(i AS DOUBLE) * 0.1::DOUBLE END AS h
       FROM num_stats, range(11) AS t(i))""",
)


def lerp(h: str = "h", lo: str = "lo") -> str:
    return f"CASE WHEN {h} - {lo} >= 0.5 THEN b.value - (b.value - a.value) * (1.0::DOUBLE - ({h} - {lo})) ELSE a.value + (b.value - a.value) * ({h} - {lo}) END"


part(
    "edges",
    f"""SELECT col, edge, row_number() OVER (PARTITION BY col ORDER BY edge) - 1 AS edge_no, count(*) OVER (PARTITION BY col) AS n_edges
    FROM (SELECT DISTINCT p.col, {lerp()} AS edge FROM edge_places p
      JOIN ref_sorted a ON a.col = p.col AND a.rk = p.lo JOIN ref_sorted b ON b.col = p.col AND b.rk = p.hi)""",
)
part("inner_edges", "SELECT col, edge FROM edges WHERE edge_no BETWEEN 1 AND n_edges - 2")
part(
    "num_freq",
    f"""SELECT col, value, count(*) FILTER ({REF}) AS ref_count, count(*) FILTER ({CUR}) AS cur_count
    FROM num_cells GROUP BY col, value""",
)
part(
    "num_buckets",
    """SELECT col, bucket, sum(ref_count) AS ref_count, sum(cur_count) AS cur_count FROM (
       SELECT f.col, f.value, any_value(ref_count) AS ref_count, any_value(cur_count) AS cur_count, count(e.edge) AS bucket
       FROM num_freq f LEFT JOIN inner_edges e ON e.col = f.col AND e.edge <= f.value GROUP BY f.col, f.value) GROUP BY col, bucket""",
)
part(
    "psi_bins",
    """SELECT d.col, d.bucket, coalesce(ref_count, 0) AS ref_count, coalesce(cur_count, 0) AS cur_count FROM (
       SELECT DISTINCT col, edge_no AS bucket FROM edges WHERE edge_no <= n_edges - 2) d
       LEFT JOIN num_buckets b ON b.col = d.col AND b.bucket = d.bucket""",
)
part(
    "psi_scores",
    """SELECT col, CASE WHEN any_value(ref_n) < 20 OR any_value(cur_n) < 20 OR any_value(n_edges) < 3 THEN 0
       ELSE sum((c - r) * ln(c / r)) END AS psi FROM (
       SELECT b.col, s.ref_n, s.cur_n, e.n_edges, greatest(ref_count / ref_n, 1e-6::DOUBLE) AS r, greatest(cur_count / cur_n, 1e-6::DOUBLE) AS c
       FROM psi_bins b JOIN num_stats s ON s.col = b.col JOIN (SELECT DISTINCT col, n_edges FROM edges) e ON e.col = b.col) GROUP BY col""",
)
part(
    "ks_scores",
    """SELECT col, ref_n, cur_n, CASE WHEN ref_n < 20 OR cur_n < 20 THEN 0 ELSE gap END AS ks FROM (
       SELECT f.col, any_value(s.ref_n) AS ref_n, any_value(s.cur_n) AS cur_n, max(abs(cr / s.ref_n - cc / s.cur_n)) AS gap FROM (
         SELECT col, sum(ref_count) OVER w AS cr, sum(cur_count) OVER w AS cc FROM num_freq WINDOW w AS (PARTITION BY col ORDER BY value)) f
       JOIN num_stats s ON s.col = f.col GROUP BY f.col)""",
)
# Small samples: of all orders of the pooled values the share whose path leaves the band, followed step by step.
part(
    "ks_small",
    """SELECT col, CAST(ref_n AS BIGINT) AS n, CAST(cur_n AS BIGINT) AS m, CAST(round(ks * ref_n * cur_n) AS BIGINT) AS edge
       FROM ks_scores WHERE ref_n >= 20 AND cur_n >= 20 AND greatest(ref_n, cur_n) <= 10000""",
)
part(
    "ks_walks",
    """SELECT col, 0::BIGINT AS step, 0::BIGINT AS i, 1.0::DOUBLE AS p, edge <= 0 AS out FROM ks_small UNION ALL
       SELECT col, step + 1, j, sum(q), abs(j * m - (step + 1 - j) * n) >= edge FROM (
         SELECT w.col, step, i + 1 AS j, p * (n - i) / (n + m - step)::DOUBLE AS q, n, m, edge FROM ks_walks w JOIN ks_small s ON s.col = w.col WHERE NOT out AND i < n
         UNION ALL SELECT w.col, step, i, p * (m - (step - i)) / (n + m - step)::DOUBLE, n, m, edge
         FROM ks_walks w JOIN ks_small s ON s.col = w.col WHERE NOT out AND step - i < m)
       GROUP BY col, step, j, n, m, edge""",
)
part(
    "ks_values",
    """SELECT k.col, ks, CASE WHEN ref_n < 20 OR cur_n < 20 THEN 1.0 WHEN greatest(ref_n, cur_n) <= 10000 THEN least(1.0, coalesce(exact, 0.0))
         WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, series)) END AS ks_pvalue
       FROM (SELECT col, ref_n, cur_n, ks, lam, (SELECT 2 * sum(CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
              * exp(-2.0::DOUBLE * k * k * lam * lam)) FROM range(1, 101) t(k)) AS series
         FROM (SELECT *, ks * sqrt(CAST(ref_n AS DOUBLE) * cur_n / (ref_n + cur_n)) AS lam FROM ks_scores)) k
       LEFT JOIN (SELECT col, sum(p) AS exact FROM ks_walks WHERE out GROUP BY col) w ON w.col = k.col""",
)
oracle(
    "coerce_numeric",
    f"""SELECT 'usage' AS "column", period, count(*) AS n_values, {r6('avg(usage)', 'mean')} FROM scored WHERE flag <> 'R' GROUP BY period
    UNION ALL SELECT 'tax', period, count(*), round(avg(tax), 6) + 0.0 FROM scored WHERE tax IS NOT NULL GROUP BY period""",
)
oracle("psi_bin_edges", f'SELECT col AS "column", {n("edge_no")}, {r6("edge")} FROM edges')
oracle(
    "psi_histogram",
    f"""SELECT b.col AS "column", {n('bucket')}, {n('ref_count')}, {n('cur_count')},
    {r6('ref_count / ref_n', 'ref_share')}, {r6('cur_count / cur_n', 'cur_share')}
    FROM psi_bins b JOIN num_stats s ON s.col = b.col""",
)
oracle("psi", f'SELECT col AS "column", {r6("psi")} FROM psi_scores')
oracle("ks_statistic", f'SELECT col AS "column", ref_n, cur_n, {r6("ks")} FROM ks_scores')
oracle("ks_pvalue", f'SELECT col AS "column", {r6("ks")}, {r6("ks_pvalue")} FROM ks_values')
oracle(
    "mean_shift",
    f'SELECT col AS "column", {r6("ref_mean")}, {r6("cur_mean")}, {r6("cur_mean - ref_mean", "mean_change")} FROM num_stats',
)
part(
    "cat_freq",
    union(
        [
            f"""SELECT '{c}' AS col, coalesce({c}, '(missing)') AS value, count(*) FILTER ({REF}) AS n_ref,
            count(*) FILTER ({CUR}) AS n_cur FROM scored GROUP BY 2"""
            for c in CATEGORICAL
        ]
    ),
)
part(
    "cat_shares",
    "SELECT *, n_ref / sum(n_ref) OVER (PARTITION BY col) AS p, n_cur / sum(n_cur) OVER (PARTITION BY col) AS q FROM cat_freq",
)
part(
    "js_scores",
    """SELECT col, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END
       + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END) AS js FROM cat_shares GROUP BY col""",
)
part(
    "cat_modes",
    """SELECT col, min(value) FILTER (rr = 1) AS ref_mode, min(value) FILTER (rc = 1) AS cur_mode FROM (
       SELECT *, row_number() OVER (PARTITION BY col ORDER BY n_ref DESC, value) AS rr,
         row_number() OVER (PARTITION BY col ORDER BY n_cur DESC, value) AS rc FROM cat_freq) GROUP BY col""",
)
oracle(
    "category_shares",
    f"""SELECT 'event_type' AS "column", value, n_ref, n_cur, {r6('n_ref / sum(n_ref) OVER ()', 'ref_share')},
    {r6('n_cur / sum(n_cur) OVER ()', 'cur_share')} FROM (
      SELECT coalesce(event_type, '(missing)') AS value, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS n_ref,
      count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n_cur FROM events GROUP BY 1)""",
)
oracle("js_divergence", f'SELECT col AS "column", {r6("js")} FROM js_scores')
oracle("category_mode", 'SELECT col AS "column", ref_mode, cur_mode FROM cat_modes')
part(
    "drift_rows",
    """SELECT s.col, 'numeric' AS kind, 'psi' AS measure, p.psi AS score, k.ks, k.ks_pvalue, ref_mean, cur_mean,
       cur_mean - ref_mean AS mean_change, NULL::VARCHAR AS ref_mode, NULL::VARCHAR AS cur_mode,
       CASE WHEN p.psi >= 0.25 THEN 'danger' WHEN p.psi >= 0.10 THEN 'warning' ELSE 'stable' END AS status
       FROM num_stats s JOIN psi_scores p ON p.col = s.col JOIN ks_values k ON k.col = s.col
       UNION ALL SELECT j.col, 'categorical', 'js', js, NULL, NULL, NULL, NULL, NULL, ref_mode, cur_mode,
       CASE WHEN js >= 0.20 THEN 'danger' WHEN js >= 0.10 THEN 'warning' ELSE 'stable' END
       FROM js_scores j JOIN cat_modes m ON m.col = j.col""",
)
DRIFT = f"""SELECT col AS "column", kind, measure, {r6('score')}, {r6('ks')}, {r6('ks_pvalue')}, {r6('ref_mean')},
    {r6('cur_mean')}, {r6('mean_change')}, ref_mode, cur_mode, status FROM drift_rows"""
oracle("drift_table", DRIFT)

# the same for the wide log
OF_DRIFT = [
    "num_cells", "num_stats", "ref_sorted", "edge_places", "edges", "inner_edges", "num_freq", "num_buckets", "psi_bins",
    "psi_scores", "ks_scores", "ks_small", "ks_walks", "ks_values", "cat_freq", "cat_shares", "js_scores", "cat_modes", "drift_rows",
]
WIDE_NUMBERS = [*NUMERIC, "proba", "pred", "y_value", "pred_value", *COPIES]


def drift_of(prefix: str, table: str, numbers: list[str], categories: list[str]) -> None:
    """The drift parts over another table, each under its name with `prefix`."""
    for name in OF_DRIFT:
        text = PARTS[name]
        if name == "num_cells":
            text = union([f"SELECT '{c}' AS col, period, CAST({c} AS DOUBLE) AS value FROM {table} WHERE {c} IS NOT NULL" for c in numbers])
        if name == "cat_freq":
            text = union(
                [
                    f"""SELECT '{c}' AS col, coalesce({c}, '(missing)') AS value, count(*) FILTER ({REF}) AS n_ref,
                    count(*) FILTER ({CUR}) AS n_cur FROM {table} GROUP BY 2"""
                    for c in categories
                ]
            )
        part(prefix + name, re.sub(rf"\b({'|'.join(OF_DRIFT)})\b", rf"{prefix}\1", text))


drift_of("wide_", "wide_log", WIDE_NUMBERS, [*CATEGORICAL, "tier", "pred_tier"])

# --- target, prediction, stand-in model ---------------------------------------------------------

KEY = f"l_orderkey, {n('l_linenumber')}"
oracle("encode_binary", f"SELECT {KEY}, {n('CASE WHEN flag = ' + chr(39) + 'R' + chr(39) + ' THEN 1 ELSE 0 END', 'encoded')} FROM scored")
part("tiers", "SELECT tier, row_number() OVER (ORDER BY tier) - 1 AS class_index FROM (SELECT DISTINCT tier FROM refrows)")
oracle(
    "encode_multiclass",
    f"SELECT {KEY}, {n('class_index')} FROM scored LEFT JOIN tiers ON tiers.tier = scored.pred_tier",
)
oracle("encode_regression", f"SELECT {KEY}, {r6('y_value', 'encoded')} FROM scored")
oracle(
    "unknown_predictions",
    "SELECT DISTINCT flag AS label FROM currows WHERE flag NOT IN (SELECT flag FROM refrows) ORDER BY 1 LIMIT 5",
)
oracle("use_logged_prediction", f"SELECT {KEY}, {n('pred', 'y_pred')}, 'logged:pred' AS source FROM currows")
oracle(
    "validate_probability",
    union(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS n_values, count(*) FILTER ({c} < 0 OR {c} > 1) AS n_outside,
            count(*) FILTER ({c} IS NULL) AS n_missing, count(*) FILTER ({c} < 0 OR {c} > 1) = 0 AS valid FROM scored"""
            for c in ("proba", "usage")
        ]
    ),
)
oracle("apply_threshold", f"SELECT {KEY}, {n('CASE WHEN proba >= 0.35::DOUBLE THEN 1 ELSE 0 END', 'y_pred')} FROM scored")
part(
    "train_rows",
    """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) <= floor(count(*) OVER () * 0.8) AS early
       FROM refrows WHERE y_true IS NOT NULL) WHERE early""",
)
oracle(
    "impute_median",
    union([f"SELECT '{c}' AS \"column\", {r6(f'median({c})', 'median')} FROM train_rows" for c in NUMERIC]),
)
oracle(
    "impute_mode",
    """SELECT col AS "column", arg_min(value, (-n, value)) AS mode, count(*) AS n_categories FROM ("""
    + union(
        [
            f"SELECT '{c}' AS col, {x} AS value, count(*) AS n FROM train_rows WHERE {x} IS NOT NULL GROUP BY 2"
            for c, x in (
                *((c, c) for c in CATEGORICAL),
                ("odd", "CASE WHEN l_linenumber <= 2 THEN '(missing)' WHEN l_linenumber <= 6 THEN flag END"),
            )
        ]
    )
    + ") GROUP BY col",
)
oracle(
    "one_hot",
    """SELECT period, CASE WHEN flag IN (SELECT flag FROM refrows) THEN flag ELSE '(all zeros)' END AS slot, count(*) AS n
       FROM scored GROUP BY 1, 2""",
)
oracle(
    "category_slots",
    """SELECT o_orderkey, CAST(coalesce(slot, (SELECT count(DISTINCT c_name) FROM customer WHERE c_custkey % 3 <> 0)) AS BIGINT) AS slot
       FROM orders JOIN customer ON c_custkey = o_custkey
       LEFT JOIN (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS slot FROM customer WHERE c_custkey % 3 <> 0 GROUP BY c_name) USING (c_name)""",
)
part(
    "holdout",
    "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) > floor(count(*) OVER () * 0.8) AS late FROM refrows) WHERE late",
)
oracle(
    "score_tables",
    f"""SELECT period, {n('class_index', 'y_true')}, count(*) AS n, count(*) AS n_sound FROM (
      SELECT period, tier FROM holdout UNION ALL SELECT period, tier FROM currows) s JOIN tiers ON tiers.tier = s.tier GROUP BY 1, 2""",
)
oracle(
    "class_weights",
    f"""SELECT class, n, {r6('sum(n) OVER () / (count(*) OVER () * n)', 'weight')}
    FROM (SELECT tier AS class, count(*) AS n FROM train_rows GROUP BY 1)""",
)

part("fitted_rows", f"SELECT period, y_true, y_value FROM holdout UNION ALL SELECT period, y_true, y_value FROM currows")
oracle(
    "fit_classifier",
    f"SELECT period, count(*) AS n, {n('sum(y_true)', 'n_positive')}, count(*) AS n_sound, true AS current_is_worse FROM fitted_rows GROUP BY 1",
)
oracle(
    "fit_regressor",
    f"SELECT period, count(*) AS n, {r6('avg(y_value)', 'mean_label')}, count(*) AS n_sound, true AS current_is_worse FROM fitted_rows GROUP BY 1",
)

# --- performance --------------------------------------------------------------------------------

CELLS = """count(*) AS n, count(*) FILTER (y_true = 0 AND pred = 0) AS tn, count(*) FILTER (y_true = 0 AND pred = 1) AS fp,
    count(*) FILTER (y_true = 1 AND pred = 0) AS fn, count(*) FILTER (y_true = 1 AND pred = 1) AS tp"""
RATES = {
    "accuracy": div("tp + tn", "tn + fp + fn + tp"),
    "precision": div("tp", "tp + fp"),
    "recall": div("tp", "tp + fn"),
    "f1": div("2 * tp", "2 * tp + fp + fn"),
    "fpr": div("fp", "fp + tn"),
    "fnr": div("fn", "fn + tp"),
}
part("conf", f"SELECT period, {CELLS} FROM scored GROUP BY period")
part("rates", f"SELECT period, {', '.join(f'{e} AS {m}' for m, e in RATES.items())} FROM conf")
part(
    "score_groups",
    "SELECT period, proba, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM scored GROUP BY period, proba",
)
part(
    "score_curve",
    """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER p AS all_pos, sum(neg) OVER p AS all_neg,
       lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, lag(pos) OVER w AS prev_pos FROM score_groups
       WINDOW w AS (PARTITION BY period ORDER BY proba DESC), p AS (PARTITION BY period)""",
)
part(
    "ranked",
    """SELECT period, sum(pos * (all_neg - fp + neg / 2)) / (any_value(all_pos) * any_value(all_neg)) AS roc_auc,
       sum(pos / all_pos * tp / (tp + fp)) AS pr_auc FROM score_curve GROUP BY period""",
)
oracle("binary_confusion", "SELECT * FROM conf")
oracle("binary_metrics", f"SELECT period, {', '.join(r6(m) for m in RATES)} FROM rates")
oracle("roc_auc", f"SELECT period, {r6('roc_auc')} FROM ranked")
oracle("pr_auc", f"SELECT period, {r6('pr_auc')} FROM ranked")
part(
    "fine_groups",
    """SELECT period, proba + CAST((l_orderkey * 7 + l_linenumber) % 100003 AS DOUBLE) / 1e7::DOUBLE AS score,
       count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM scored GROUP BY 1, 2""",
)
part(
    "fine_curve",
    """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER p AS all_pos, sum(neg) OVER p AS all_neg FROM fine_groups
       WINDOW w AS (PARTITION BY period ORDER BY score DESC), p AS (PARTITION BY period)""",
)
oracle(
    "ranked_metrics_fine",
    f"""SELECT period, {r6('sum(pos * (all_neg - fp + neg / 2)) / (any_value(all_pos) * any_value(all_neg))', 'roc_auc')},
       {r6('sum(pos / all_pos * tp / (tp + fp))', 'pr_auc')} FROM fine_curve GROUP BY period""",
)
oracle(
    "roc_curve",
    f"""SELECT period, {r6('proba', 'threshold')}, {r6('fp / all_neg', 'fpr')}, {r6('tp / all_pos', 'tpr')} FROM score_curve
    WHERE prev_pos IS NULL OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
    UNION ALL SELECT DISTINCT period, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM scored""",
)
oracle(
    "pr_curve",
    f"""SELECT period, {r6('proba', 'threshold')}, {r6('tp / all_pos', 'recall')}, {r6('tp / (tp + fp)', 'precision')} FROM score_curve
    UNION ALL SELECT DISTINCT period, NULL::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM scored""",
)
part("tier_cells", "SELECT period, tier AS actual, pred_tier AS predicted, count(*) AS n FROM scored GROUP BY 1, 2, 3")
part("tier_labels", "SELECT DISTINCT actual AS label FROM tier_cells UNION SELECT DISTINCT predicted FROM tier_cells")
oracle(
    "confusion_matrix",
    """SELECT p.period, a.label AS actual, b.label AS predicted, coalesce(c.n, 0) AS n
       FROM (SELECT DISTINCT period FROM scored) p, tier_labels a, tier_labels b
       LEFT JOIN tier_cells c ON c.period = p.period AND c.actual = a.label AND c.predicted = b.label""",
)
oracle(
    "confusion_pivot",
    """SELECT period, tier AS actual, count(*) FILTER (pred_tier = 'Basic') AS "Basic", count(*) FILTER (pred_tier = 'Plus') AS "Plus",
       count(*) FILTER (pred_tier = 'Premium') AS "Premium" FROM scored GROUP BY 1, 2""",
)


def macro(table: str, keys: str) -> str:
    """Macro figures per `keys` over the labels seen as truth or prediction."""
    return f"""SELECT {keys}, sum(actual_n) AS n, sum(tp) / sum(actual_n) AS accuracy,
      avg(CASE WHEN actual_n > 0 THEN {div('tp', 'actual_n')} END) AS balanced_accuracy,
      avg({div('tp', 'predicted_n')}) AS macro_precision, avg({div('tp', 'actual_n')}) AS macro_recall,
      avg({div('2 * tp', 'actual_n + predicted_n')}) AS macro_f1
    FROM (SELECT {keys}, label, sum(tp) AS tp, sum(a) AS actual_n, sum(p) AS predicted_n FROM (
      SELECT {keys}, actual AS label, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp, n AS a, 0 AS p FROM {table}
      UNION ALL SELECT {keys}, predicted, 0, 0, n FROM {table}) GROUP BY {keys}, label) GROUP BY {keys}"""


MACRO = ["accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1"]
part("macro_rates", macro("tier_cells", "period"))
part(
    "log_losses",
    """SELECT period, -avg(ln(greatest(least(CASE tier WHEN 'Basic' THEN (1 - q) * (1 - q) WHEN 'Plus' THEN 2 * q * (1 - q) ELSE q * q END,
       1 - 2.220446049250313e-16::DOUBLE), 2.220446049250313e-16::DOUBLE))) AS log_loss
       FROM (SELECT period, tier, (pred_value - 1000.0::DOUBLE) / 50.0::DOUBLE / 50.0::DOUBLE AS q FROM scored) GROUP BY period""",
)
part(
    "fit_errors",
    """SELECT period, avg(abs(y_value - pred_value)) AS mae, sqrt(avg((y_value - pred_value) * (y_value - pred_value))) AS rmse,
       1 - sum((y_value - pred_value) * (y_value - pred_value)) / (var_pop(y_value) * count(*)) AS r2 FROM scored GROUP BY period""",
)
oracle("multiclass_metrics", f"SELECT period, {', '.join(r6(m) for m in MACRO)} FROM macro_rates")
oracle("log_loss", f"SELECT period, {r6('log_loss')} FROM log_losses")
oracle("regression_metrics", f"SELECT period, {r6('mae')}, {r6('rmse')}, {r6('r2')} FROM fit_errors")
oracle(
    "residuals",
    f"SELECT {KEY}, {r6('y_value', 'actual')}, {r6('pred_value', 'predicted')}, {r6('y_value - pred_value', 'error')} FROM scored",
)


def comparison(sources: list[tuple[str, list[str]]]) -> str:
    """(ord, metric, before, after) from tables with one row per period."""
    rows = []
    for table, metrics in sources:
        for m in metrics:
            rows.append(
                f"SELECT {len(rows)} AS ord, '{m}' AS metric, max({m}) FILTER ({REF}) AS before, max({m}) FILTER ({CUR}) AS after FROM {table}"
            )
    return union(rows)


part("perf_binary", comparison([("rates", list(RATES)), ("ranked", ["roc_auc", "pr_auc"])]))
part("perf_multiclass", comparison([("macro_rates", MACRO), ("log_losses", ["log_loss"])]))
part("perf_regression", comparison([("fit_errors", ["mae", "rmse", "r2"])]))
PERF = """SELECT {ord}, metric, {before}, {after}, {change}, {points}, {relative} FROM {table}"""


def performance(table: str) -> str:
    return PERF.format(
        ord=n("ord"),
        before=r6("before"),
        after=r6("after"),
        change=r6("after - before", "change"),
        points=r6("CASE WHEN metric <> 'log_loss' THEN (after - before) * 100 END", "change_points"),
        relative=r6("CASE WHEN before <> 0 THEN (after - before) / abs(before) END", "relative_change"),
        table=table,
    )


oracle("performance_table", performance("perf_multiclass"))
oracle("json_performance", performance("perf_binary"))
oracle(
    "performance_long",
    f"""SELECT {n('ord')}, metric, 'reference' AS period, {r6('before', 'value')} FROM perf_binary
    UNION ALL SELECT ord, metric, 'current', round(after, 6) + 0.0 FROM perf_binary""",
)

# --- calibration --------------------------------------------------------------------------------

BIN = " + ".join(f"CASE WHEN {i}::DOUBLE * 0.1::DOUBLE < proba THEN 1 ELSE 0 END" for i in range(1, 10))
oracle(
    "calibration_curve",
    f"""SELECT period, {n(BIN, 'bin')}, count(*) AS n, {r6('avg(proba)', 'mean_probability')}, {r6('avg(y_true)', 'positive_rate')}
    FROM scored GROUP BY 1, 2""",
)
part(
    "brier",
    f"""SELECT *, cur_brier - ref_brier AS brier_delta FROM (
    SELECT avg((proba - y_true) * (proba - y_true)) FILTER ({REF}) AS ref_brier,
      avg((proba - y_true) * (proba - y_true)) FILTER ({CUR}) AS cur_brier FROM scored)""",
)
BRIER = f"SELECT {r6('ref_brier')}, {r6('cur_brier')}, {r6('brier_delta')}"
ASSESSED = "CASE WHEN brier_delta >= 0.03 THEN 'overconfidence_rising' ELSE 'no_big_change' END"
oracle("brier_score", f"{BRIER} FROM brier")
oracle("calibration_assessment", f"{BRIER}, {ASSESSED} AS assessment FROM brier")
oracle("json_calibration", f"{BRIER}, {ASSESSED} AS assessment FROM brier")

# --- segments -----------------------------------------------------------------------------------

oracle(
    "segment_columns",
    "SELECT *, n_groups <= 30 AS kept FROM ("
    + union(
        [
            f"""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'reference' ELSE 'current' END AS period, '{c}' AS segment_column,
            count(DISTINCT coalesce({c}, '(missing)')) AS n_groups FROM customer GROUP BY 1"""
            for c in ("c_name", "c_mktsegment")
        ]
    )
    + ")",
)
part(
    "seg_rows",
    union([f"SELECT *, '{c}' AS segment_column, coalesce({c}, '(missing)') AS segment_group FROM scored" for c in CATEGORICAL]),
)
SEG = "period, segment_column, segment_group"
part("seg_conf", f"SELECT {SEG}, {CELLS} FROM seg_rows GROUP BY {SEG}")
part(
    "seg_binary",
    f"""SELECT *, CASE WHEN n < 30 OR positives < 10 OR negatives < 10 THEN 'insufficient'
      WHEN recall_gap <= -0.20 OR fpr_gap >= 0.20 THEN 'danger' WHEN recall_gap <= -0.10 OR fpr_gap >= 0.10 THEN 'warning'
      ELSE 'stable' END AS status
    FROM (SELECT s.*, s.recall - r.recall AS recall_gap, s.fpr - r.fpr AS fpr_gap FROM (
      SELECT {SEG}, n, tp + fn AS positives, tn + fp AS negatives, {', '.join(f'{e} AS {m}' for m, e in RATES.items())} FROM seg_conf) s
    JOIN rates r ON r.period = s.period)""",
)
part("seg_cells", f"SELECT {SEG}, tier AS actual, pred_tier AS predicted, count(*) AS n FROM seg_rows GROUP BY {SEG}, tier, pred_tier")
part("seg_macro", macro("seg_cells", SEG))
part(
    "seg_multiclass",
    """SELECT *, CASE WHEN n < 30 THEN 'insufficient' WHEN macro_f1_gap <= -0.20 THEN 'danger'
      WHEN macro_f1_gap <= -0.10 THEN 'warning' ELSE 'stable' END AS status
    FROM (SELECT s.period, segment_column, segment_group, s.n, s.accuracy, s.macro_f1, s.macro_f1 - m.macro_f1 AS macro_f1_gap
      FROM seg_macro s JOIN macro_rates m ON m.period = s.period)""",
)
part(
    "seg_regression",
    f"""SELECT *, CASE WHEN n < 30 THEN 'insufficient' WHEN mae_ratio >= 1.5 THEN 'danger' WHEN mae_ratio >= 1.25 THEN 'warning'
      ELSE 'stable' END AS status
    FROM (SELECT s.*, s.mae / greatest(e.mae, 1e-9::DOUBLE) AS mae_ratio FROM (
      SELECT {SEG}, count(*) AS n, avg(abs(y_value - pred_value)) AS mae FROM seg_rows GROUP BY {SEG}) s
    JOIN fit_errors e ON e.period = s.period)""",
)
SEG_BINARY = f"""SELECT {SEG}, {n('n')}, {n('positives')}, {n('negatives')}, {', '.join(r6(m) for m in RATES)},
    {r6('recall_gap')}, {r6('fpr_gap')}, status FROM seg_binary"""
oracle("segments_binary", SEG_BINARY)
oracle(
    "segments_multiclass",
    f"SELECT {SEG}, {n('n')}, {r6('accuracy')}, {r6('macro_f1')}, {r6('macro_f1_gap')}, status FROM seg_multiclass",
)
oracle("segments_regression", f"SELECT {SEG}, {n('n')}, {r6('mae')}, {r6('mae_ratio')}, status FROM seg_regression")
oracle(
    "weak_segments",
    f"SELECT segment_column, segment_group, n, status FROM seg_binary WHERE {CUR} AND status IN ('warning', 'danger')",
)
oracle("json_segments", f"{SEG_BINARY} WHERE {CUR} ORDER BY segment_column, segment_group LIMIT 15")

# --- thresholds ---------------------------------------------------------------------------------

part("steps", "SELECT round(0.10 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(17) t(i)")
part(
    "sweep_cells",
    """SELECT threshold, count(*) FILTER (y_true = 1 AND proba >= threshold) AS tp, count(*) FILTER (y_true = 0 AND proba >= threshold) AS fp,
       count(*) FILTER (y_true = 1 AND proba < threshold) AS fn FROM currows, steps GROUP BY threshold""",
)
part("sweep", f"SELECT threshold, {RATES['precision']} AS precision, {RATES['recall']} AS recall, {RATES['f1']} AS f1, fp, fn FROM sweep_cells")
SWEEP = f"SELECT {r6('threshold')}, {r6('precision')}, {r6('recall')}, {r6('f1')}, fp, fn FROM sweep"
oracle("threshold_sweep", SWEEP)
oracle("best_threshold", f"SELECT * FROM ({SWEEP}) ORDER BY f1 DESC, threshold LIMIT 1")
oracle("json_thresholds", f"SELECT * FROM ({SWEEP}) ORDER BY f1 DESC, threshold LIMIT 5")
part(
    "gain",
    """SELECT b.threshold AS best_threshold, b.f1 AS best_f1, c.threshold AS nearest_threshold, c.f1 AS nearest_f1,
       b.f1 - c.f1 AS improvement, CASE WHEN b.f1 - c.f1 >= 0.03 THEN 'short_term' ELSE 'monitor' END AS priority
       FROM (SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1) b,
         (SELECT * FROM sweep ORDER BY abs(threshold - 0.5::DOUBLE), threshold LIMIT 1) c""",
)
oracle(
    "threshold_improvement",
    f"""SELECT {r6('best_threshold')}, {r6('best_f1')}, {r6('nearest_threshold')}, {r6('nearest_f1')}, {r6('improvement')}, priority
    FROM gain""",
)
oracle(
    "threshold_long",
    union([f"SELECT {r6('threshold')}, '{m}' AS measure, {r6(m, 'value')} FROM sweep" for m in ("precision", "recall", "f1", "fp", "fn")]),
)

# --- health -------------------------------------------------------------------------------------


def clip(text: str) -> str:
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {text}))"


def statuses(component: str, table: str, danger: int, warning: int, where: str = "true") -> str:
    d, w = f"count(*) FILTER (status = 'danger' AND {where})", f"count(*) FILTER (status = 'warning' AND {where})"
    return f"""SELECT '{component}' AS component, {clip(f'(100 - {d} * {danger} - {w} * {warning})::DOUBLE')} AS score,
    printf('danger %d, warning %d', {d}, {w}) AS reason FROM {table}"""


def value(table: str, metric: str, side: str) -> str:
    return f"(SELECT {side} FROM {table} WHERE metric = '{metric}')"


def drop(table: str, metric: str) -> str:
    return f"greatest(0.0::DOUBLE, {value(table, metric, 'before')} - {value(table, metric, 'after')})"


def rise(table: str, metric: str) -> str:
    return f"greatest(0.0::DOUBLE, {value(table, metric, 'after')} / greatest({value(table, metric, 'before')}, 1e-9::DOUBLE) - 1)"


def dropped(table: str, metrics: list[tuple[str, int]]) -> str:
    score = "100.0::DOUBLE" + "".join(f" - {drop(table, m)} * {c}" for m, c in metrics)
    text = ", ".join(f"{m} -%.1f" for m, _ in metrics) + " points"
    return f"""SELECT 'performance' AS component, {clip(score)} AS score,
    printf('{text}', {', '.join(f'{drop(table, m)} * 100' for m, _ in metrics)}) AS reason"""


part("h_performance_binary", dropped("perf_binary", [("recall", 170), ("f1", 120), ("roc_auc", 80)]))
part(
    "h_performance_multiclass",
    dropped("perf_multiclass", [("macro_recall", 150), ("macro_f1", 140), ("balanced_accuracy", 80)]),
)
P = "perf_regression"
part(
    "h_performance_regression",
    f"""SELECT 'performance' AS component, {clip(f"100.0::DOUBLE - {rise(P, 'mae')} * 55 - {rise(P, 'rmse')} * 35 - {drop(P, 'r2')} * 35")} AS score,
    printf('mae +%.1f%%, rmse +%.1f%%, r2 -%.3f', {rise(P, 'mae')} * 100, {rise(P, 'rmse')} * 100, {drop(P, 'r2')}) AS reason""",
)
part(
    "h_reliability",
    f"""SELECT 'reliability' AS component, {clip('100.0::DOUBLE - cur_brier * 170 - greatest(0.0::DOUBLE, brier_delta) * 180')} AS score,
    printf('brier %.3f, up %.3f', cur_brier, greatest(0.0::DOUBLE, brier_delta)) AS reason FROM brier""",
)
part("h_noreliability", "SELECT 'reliability' AS component, NULL::DOUBLE AS score, 'no calibration' AS reason")
part("h_stability", statuses("stability", "drift_rows", 16, 6))
TASKS = {"binary": "quality_rows", "multiclass": "quality_tier", "regression": "quality_value"}
for kind, quality_name in TASKS.items():
    part(f"h_quality_{kind}", statuses("quality", quality_name, 18, 7))
    part(f"h_segments_{kind}", statuses("segments", f"seg_{kind}", 18, 7, CUR))
    reliability = "h_reliability" if kind == "binary" else "h_noreliability"
    used = [f"h_quality_{kind}", "h_stability", f"h_performance_{kind}", reliability, f"h_segments_{kind}"]
    part(
        f"components_{kind}",
        union(
            [
                f"""SELECT {i} AS ord, component, score, {w}::DOUBLE AS weight, reason,
                CASE WHEN score IS NULL THEN 'unavailable' ELSE 'computed' END AS state FROM {t}"""
                for i, (t, w) in enumerate(zip(used, (0.15, 0.25, 0.30, 0.10, 0.20)))
            ]
        ),
    )
    part(
        f"health_{kind}",
        f"""SELECT score, CASE WHEN score >= 80 THEN 'low' WHEN score >= 60 THEN 'medium' ELSE 'high' END AS risk,
        CASE WHEN rows >= 500 AND n_unavailable = 0 THEN 'high' WHEN rows >= 200 THEN 'medium' ELSE 'low' END AS confidence, n_unavailable
        FROM (SELECT round_even(sum(score * weight) / sum(weight) FILTER (score IS NOT NULL), 1) AS score,
          count(*) FILTER (score IS NULL) AS n_unavailable FROM components_{kind}), (SELECT count(*) AS rows FROM currows)""",
    )


def component(table: str) -> str:
    return f"SELECT component, {r6('score')}, reason FROM {table}"


HEALTH = "SELECT " + r6("score") + ", risk, confidence, n_unavailable FROM health_{}"
COMPONENTS = f"SELECT {n('ord')}, component, {r6('score')}, {r6('weight')}, reason, state FROM components_binary"
oracle("health_quality", component("h_quality_binary"))
oracle("health_stability", component("h_stability"))
oracle("health_performance_binary", component("h_performance_binary"))
oracle("health_performance_multiclass", component("h_performance_multiclass"))
oracle("health_performance_regression", component("h_performance_regression"))
oracle("health_reliability", component("h_reliability"))
oracle("health_segments", component("h_segments_binary"))
oracle("health_score", HEALTH.format("binary"))
oracle("health_components", COMPONENTS)
oracle("json_health", HEALTH.format("multiclass"))
oracle("component_scores", f"SELECT {n('ord')}, component, {r6('score')} FROM components_multiclass WHERE score IS NOT NULL")

# --- report -------------------------------------------------------------------------------------

part(
    "f_drift",
    """SELECT 1 AS ord, CASE WHEN limit_name = 'danger' THEN 'strong_drift' ELSE 'drift_watch' END AS finding,
       CASE WHEN limit_name = 'danger' THEN 'high' ELSE 'medium' END AS severity,
       printf('%d columns past the %s limit', count(*), limit_name) AS evidence,
       string_agg(col, ',' ORDER BY score DESC, col) FILTER (place <= 5) AS affected_columns
       FROM (SELECT d.*, d.status AS limit_name, row_number() OVER (ORDER BY score DESC, col) AS place FROM drift_rows d
         WHERE status = (SELECT min(status) FROM drift_rows WHERE status IN ('danger', 'warning'))) GROUP BY limit_name""",
)


def performance_finding(table: str, recall: str, f1: str) -> str:
    return f"""SELECT 2 AS ord, 'performance_drop' AS finding, CASE WHEN r0 - r1 >= 0.20 THEN 'high' ELSE 'medium' END AS severity,
    printf('{recall} %.3f -> %.3f, {f1} -%.1f points', r0, r1, f1_drop * 100) AS evidence, '' AS affected_columns
    FROM (SELECT {value(table, recall, 'before')} AS r0, {value(table, recall, 'after')} AS r1,
      {value(table, f1, 'before')} - {value(table, f1, 'after')} AS f1_drop) WHERE r0 - r1 >= 0.10 OR f1_drop >= 0.10"""


part("f_performance_binary", performance_finding("perf_binary", "recall", "f1"))
part("f_performance_multiclass", performance_finding("perf_multiclass", "macro_recall", "macro_f1"))
part(
    "f_performance_regression",
    f"""SELECT 2 AS ord, 'error_increase' AS finding, CASE WHEN up >= 0.35 THEN 'high' ELSE 'medium' END AS severity,
    printf('mae %.3f -> %.3f (+%.1f%%)', b, a, up * 100) AS evidence, '' AS affected_columns
    FROM (SELECT a, b, a / greatest(b, 1e-9::DOUBLE) - 1 AS up
      FROM (SELECT {value(P, 'mae', 'before')} AS b, {value(P, 'mae', 'after')} AS a)) WHERE up >= 0.15""",
)
part(
    "f_calibration",
    """SELECT 3 AS ord, 'calibration_worse' AS finding, 'medium' AS severity,
       printf('brier %.3f -> %.3f', ref_brier, cur_brier) AS evidence, '' AS affected_columns FROM brier WHERE brier_delta >= 0.03""",
)
for kind, metric, way in (("binary", "recall", "DESC"), ("multiclass", "macro_f1", "DESC"), ("regression", "mae", "ASC")):
    part(
        f"f_segment_{kind}",
        f"""SELECT 4 AS ord, 'weak_segment' AS finding, CASE WHEN status = 'danger' THEN 'high' ELSE 'medium' END AS severity,
        printf('%s=%s n=%d {metric}=%.3f', segment_column, segment_group, CAST(n AS BIGINT), {metric}) AS evidence,
        segment_column AS affected_columns FROM seg_{kind} WHERE {CUR} AND status IN ('danger', 'warning')
        ORDER BY CASE WHEN status = 'danger' THEN 0 ELSE 1 END, {metric} {way}, segment_column, segment_group LIMIT 1""",
    )
    found = ["f_drift", f"f_performance_{kind}", *(["f_calibration"] if kind == "binary" else []), f"f_segment_{kind}"]
    part(f"some_findings_{kind}", union([f"SELECT * FROM {f}" for f in found]))
    part(
        f"findings_{kind}",
        f"""SELECT * FROM some_findings_{kind} UNION ALL SELECT 9, 'no_strong_signal', 'low', 'no key figure is past its limit', ''
        WHERE NOT EXISTS (SELECT * FROM some_findings_{kind})""",
    )
FINDING = f"SELECT {n('ord')}, finding, severity, evidence, affected_columns FROM "
oracle("finding_drift", FINDING + "f_drift")
oracle("finding_performance", FINDING + "f_performance_regression")
oracle("finding_calibration", FINDING + "f_calibration")
oracle("finding_segment", FINDING + "f_segment_regression")
oracle("findings", FINDING + "findings_binary")
oracle(
    "severity_counts",
    f"""SELECT {n('d.ord', 'ord')}, d.severity, count(f.finding) AS n FROM (VALUES (0, 'high'), (1, 'medium'), (2, 'low')) d(ord, severity)
    LEFT JOIN findings_binary f ON f.severity = d.severity GROUP BY 1, 2""",
)
A_DRIFT = """SELECT 1 AS ord, 'immediate' AS priority, 'check_collection_of_drifted_columns' AS action,
    printf('%d columns drift', count(*)) AS reason FROM drift_rows WHERE status = 'danger' HAVING count(*) > 0"""
A_LAST = "SELECT 5, 'monitor', 'track_drift_and_groups_weekly', 'tell passing changes from lasting ones'"


def retrain(table: str, metric: str, condition: str) -> str:
    return f"""SELECT 2, 'short_term', 'try_retraining_on_recent_labels', '{metric} got worse'
    FROM (SELECT {value(table, metric, 'before')} AS b, {value(table, metric, 'after')} AS a) WHERE {condition}"""


part(
    "actions_binary",
    union(
        [
            A_DRIFT,
            retrain("perf_binary", "recall", "b - a >= 0.10"),
            """SELECT 3, priority, printf('review_threshold_%.2f', best_threshold),
               printf('f1 %+.3f against the current setting', improvement) FROM gain""",
            "SELECT 4, 'short_term', 'try_probability_calibration', 'brier score got worse' FROM brier WHERE brier_delta >= 0.03",
            A_LAST,
        ]
    ),
)
part("actions_multiclass", union([A_DRIFT, retrain("perf_multiclass", "macro_recall", "b - a >= 0.10"), A_LAST]))
part("actions_regression", union([A_DRIFT, retrain("perf_regression", "mae", "a > b * 1.15::DOUBLE"), A_LAST]))
oracle("actions", f"SELECT {n('ord')}, priority, action, reason FROM actions_binary")
for kind in TASKS:
    part(
        f"limits_{kind}",
        f"""SELECT ord, limitation FROM (VALUES (2, 'calibration_and_thresholds_are_binary_only', {str(kind != 'binary').lower()}),
          (5, 'nothing_is_applied_automatically', true)) t(ord, limitation, holds) WHERE holds
        UNION ALL SELECT 3, 'fewer_than_200_current_rows' FROM (SELECT count(*) AS c FROM currows) WHERE c < 200
        UNION ALL SELECT 4, 'groups_with_too_few_samples' FROM seg_{kind} WHERE status = 'insufficient' HAVING count(*) > 0""",
    )
oracle("limitations", f"SELECT {n('ord')}, limitation FROM limits_multiclass")
oracle(
    "report_summary",
    f"""SELECT {r6('score')}, risk, confidence,
    printf('health score %.1f/100, risk %s, confidence %s', score, risk, confidence) AS summary FROM health_regression""",
)
oracle(
    "headline_counts",
    f"""SELECT (SELECT count(*) FROM drift_rows WHERE status = 'danger') AS danger_drift,
    (SELECT count(*) FROM seg_binary WHERE {CUR} AND status IN ('warning', 'danger')) AS weak_groups,
    (SELECT count(*) FROM actions_binary WHERE priority = 'immediate') AS immediate_actions""",
)
oracle(
    "json_top_drift",
    f"SELECT col AS \"column\", kind, measure, {r6('score')}, status FROM drift_rows ORDER BY drift_rows.score DESC, col LIMIT 10",
)

# --- chart tables -------------------------------------------------------------------------------


def both_sides(table: str, ids: str, ref: str, cur: str, name: str, number=r6) -> str:
    return f"SELECT {ids}, 'reference' AS period, {number(ref, name)} FROM {table} UNION ALL SELECT {ids}, 'current', {number(cur, name)} FROM {table}"


part(
    "top_missing",
    'SELECT * FROM quality_wide WHERE NOT is_target ORDER BY greatest(ref_missing_rate, cur_missing_rate) DESC, "column" LIMIT 15',
)
part("top_distinct", 'SELECT * FROM quality_wide ORDER BY abs(cur_distinct - ref_distinct) DESC, "column" LIMIT 12')
oracle("missing_top", both_sides("top_missing", '"column"', "ref_missing_rate", "cur_missing_rate", "missing_rate"))
oracle("distinct_change_top", both_sides("top_distinct", '"column"', "ref_distinct", "cur_distinct", "n_distinct", n))
oracle(
    "quality_status_counts",
    f"""SELECT {n('d.ord', 'ord')}, d.status, count(q.status) AS n FROM (VALUES (0, 'danger'), (1, 'warning'), (2, 'stable')) d(ord, status)
    LEFT JOIN quality_rows q ON q.status = d.status GROUP BY 1, 2""",
)
oracle(
    "class_shares",
    f"""SELECT period, class, n, {r6('n / sum(n) OVER (PARTITION BY period)', 'share')}
    FROM (SELECT period, coalesce(tier, '(missing)') AS class, count(*) AS n FROM scored GROUP BY 1, 2)""",
)
oracle(
    "drift_top",
    f'SELECT col AS "column", measure, {r6("score")}, status FROM wide_drift_rows ORDER BY wide_drift_rows.score DESC, col LIMIT 10',
)
oracle("drift_scores", f'SELECT col AS "column", {r6("score")} FROM drift_rows')


def bins(expression: str, count: int) -> str:
    return f"""SELECT period, {n('bin')}, {r6('lo + bin * w', 'low')}, {r6('lo + bin * w + w', 'high')}, count(*) AS n FROM (
      SELECT period, lo, w, least(floor((v - lo) / w), {count - 1}) AS bin FROM (SELECT period, {expression} AS v FROM scored),
      (SELECT min({expression}) AS lo, (max({expression}) - min({expression})) / {count}.0::DOUBLE AS w FROM scored) WHERE v IS NOT NULL)
    GROUP BY period, bin, lo, w"""


oracle("numeric_histogram", bins("amount", 35))
oracle("probability_histogram", bins("proba", 20))
oracle("residual_histogram", bins("(y_value - pred_value)", 35))
part(
    "quartiles",
    """SELECT period, count(amount) AS n, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS median,
       quantile_cont(amount, 0.75) AS q3 FROM scored GROUP BY period""",
)
INSIDE = "amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
oracle(
    "numeric_box",
    f"""SELECT s.period, n, {r6('q1')}, {r6('median')}, {r6('q3')}, {r6('min(amount)', 'minimum')}, {r6('max(amount)', 'maximum')},
    {r6(f'min(amount) FILTER ({INSIDE})', 'low_whisker')}, {r6(f'max(amount) FILTER ({INSIDE})', 'high_whisker')},
    count(*) FILTER (NOT ({INSIDE})) AS n_outliers
    FROM scored s JOIN quartiles t ON t.period = s.period WHERE amount IS NOT NULL GROUP BY s.period, n, q1, median, q3""",
)
part(
    "brands",
    """SELECT p_brand AS value, count(*) FILTER (p_partkey % 2 = 0) AS n_ref, count(*) FILTER (p_partkey % 2 = 1) AS n_cur
       FROM part GROUP BY 1""",
)
part(
    "brand_shares",
    """SELECT * FROM (SELECT *, n_ref / sum(n_ref) OVER () AS p, n_cur / sum(n_cur) OVER () AS q,
       row_number() OVER (ORDER BY n_ref DESC, value) AS rr, row_number() OVER (ORDER BY n_cur DESC, value) AS rc FROM brands)
       WHERE (rr <= 15 AND n_ref > 0) OR (rc <= 15 AND n_cur > 0)""",
)
oracle("category_top_shares", both_sides("brand_shares", "value", "p", "q", "share"))
oracle(
    "box_extremes",
    f"""SELECT period, side, {n('place')}, l_orderkey, {n('l_linenumber')}, {r6('amount', 'value')} FROM (
      SELECT *, row_number() OVER (PARTITION BY period, side ORDER BY CASE WHEN side = 'low' THEN amount ELSE -amount END, l_orderkey, l_linenumber) AS place FROM (
        SELECT s.period, l_orderkey, l_linenumber, amount, CASE WHEN amount < q1 - 1.5 * (q3 - q1) THEN 'low' ELSE 'high' END AS side
        FROM scored s JOIN quartiles t ON t.period = s.period WHERE NOT ({INSIDE}))) WHERE place <= 20""",
)
oracle(
    "scatter_points",
    f"""SELECT period, l_orderkey, {n('l_linenumber')}, {r6('y_value', 'actual')}, {r6('pred_value', 'predicted')} FROM scored
    QUALIFY row_number() OVER (PARTITION BY period ORDER BY md5(concat(l_orderkey, '|', l_linenumber)), l_orderkey, l_linenumber) <= 500""",
)
oracle(
    "scatter_grid",
    f"""SELECT period, {n('least(floor((y_value - lo) / w), 49)', 'x')}, {n('least(floor((pred_value - lo) / w), 49)', 'y')}, count(*) AS n FROM scored,
    (SELECT least(min(y_value), min(pred_value)) AS lo, greatest(max(y_value), max(pred_value)) / 50::DOUBLE - least(min(y_value), min(pred_value)) / 50::DOUBLE AS w FROM scored)
    GROUP BY 1, 2, 3""",
)
oracle(
    "histogram_with_infinities",
    f"""SELECT period, {n('bin')}, CASE WHEN bin < 0 THEN '-inf'::DOUBLE WHEN bin > 34 THEN 'inf'::DOUBLE ELSE round(lo + bin * w, 6) + 0.0 END AS low,
      CASE WHEN bin < 0 THEN '-inf'::DOUBLE WHEN bin > 34 THEN 'inf'::DOUBLE ELSE round(lo + bin * w + w, 6) + 0.0 END AS high, count(*) AS n FROM (
      SELECT period, lo, w, CASE l_orderkey % 100 WHEN 0 THEN 35 WHEN 1 THEN -1 ELSE least(floor((amount - lo) / w), 34) END AS bin FROM scored,
      (SELECT min(amount) AS lo, (max(amount) - min(amount)) / 35.0::DOUBLE AS w FROM scored WHERE l_orderkey % 100 > 1) WHERE amount IS NOT NULL OR l_orderkey % 100 < 2)
    GROUP BY period, bin, lo, w""",
)
oracle(
    "duplicate_instants",
    "SELECT count(*) AS n_rows, count(*) - count(DISTINCT event_id % 240) AS duplicate_rows FROM events",
)
oracle(
    "quality_of_instants",
    """SELECT 'at' AS "column", count(DISTINCT CASE WHEN event_id % 2 = 0 THEN event_id % 240 END) AS ref_distinct,
         count(DISTINCT CASE WHEN event_id % 2 = 1 THEN event_id % 240 END) AS cur_distinct FROM events
       UNION ALL SELECT 'big', count(DISTINCT CASE WHEN event_id % 2 = 0 THEN event_id % 9 END),
         count(DISTINCT CASE WHEN event_id % 2 = 1 THEN CAST(9007199254740992 + event_id % 9 AS DOUBLE) END) FROM events""",
)
# Of all orders of the pooled values the share whose path leaves the band: walks step by step, by the values drawn of the first side.
oracle(
    "ks_pvalue_exact",
    f"""WITH RECURSIVE cells AS (SELECT s_acctbal AS v, s_suppkey % 3 <> 0 AS is_ref FROM supplier),
    sizes AS (SELECT count(*) FILTER (is_ref) AS n, count(*) FILTER (NOT is_ref) AS m FROM cells),
    gaps AS (SELECT max(abs(r * m - c * n)) AS edge, any_value(n) AS n, any_value(m) AS m FROM sizes,
      (SELECT DISTINCT v, count(*) FILTER (is_ref) OVER (ORDER BY v) AS r, count(*) FILTER (NOT is_ref) OVER (ORDER BY v) AS c FROM cells)),
    walk(step, i, p, out) AS (SELECT 0, 0, 1.0::DOUBLE, false UNION ALL
      SELECT step + 1, j, sum(q), abs(j * m - (step + 1 - j) * n) >= edge FROM (
        SELECT step, i + 1 AS j, p * (n - i) / (n + m - step)::DOUBLE AS q, n, m, edge FROM walk, gaps WHERE NOT out AND i < n
        UNION ALL SELECT step, i, p * (m - (step - i)) / (n + m - step)::DOUBLE, n, m, edge FROM walk, gaps WHERE NOT out AND step - i < m)
      GROUP BY step, j, n, m, edge)
    SELECT 's_acctbal' AS "column", {r6('edge / (n * m)::DOUBLE', 'ks')}, {r6('(SELECT sum(p) FROM walk WHERE out)', 'ks_pvalue')} FROM gaps""",
)
oracle(
    "scatter_bounds",
    f"""SELECT period, {r6('least(min(y_value), min(pred_value))', 'low')}, {r6('greatest(max(y_value), max(pred_value))', 'high')}
    FROM scored GROUP BY period""",
)
oracle(
    "segment_metrics_long",
    union(
        [
            f"""SELECT period, segment_group, '{m}' AS metric, {r6(m, 'value')} FROM seg_binary
            WHERE segment_column = 'flag' AND status <> 'insufficient'"""
            for m in ("recall", "f1", "fpr", "fnr")
        ]
    ),
)
oracle(
    "segment_matrix",
    union(
        [
            f"""SELECT '{m}' AS metric, {', '.join(r6(f"max({m}) FILTER (segment_group = '{g}')", '"' + g + '"') for g in 'ANRX')}
            FROM seg_multiclass WHERE segment_column = 'flag' AND {CUR} AND status <> 'insufficient'"""
            for m in ("macro_f1", "accuracy")
        ]
    ),
)

# --- composed -----------------------------------------------------------------------------------

FIGURE = {"binary": "recall", "multiclass": "macro_f1", "regression": "mae"}


def overview(kind: str) -> str:
    def rows(section: str, item: str, measure: str, number: str, status: str, table: str) -> str:
        return f"""SELECT '{section}' AS section, {item} AS item, {measure} AS measure, {r6(number, 'value')}, {status} AS status FROM {table}"""

    parts = [
        rows("quality", '"column"', "'missing_delta'", "missing_delta", "status", TASKS[kind]),
        rows("drift", "col", "measure", "score", "status", "drift_rows"),
        rows("performance", "metric", "'before'", "before", "NULL::VARCHAR", f"perf_{kind}"),
        rows("performance", "metric", "'after'", "after", "NULL", f"perf_{kind}"),
        rows(
            "segment", "period || '/' || segment_column || '/' || segment_group", f"'{FIGURE[kind]}'", FIGURE[kind], "status", f"seg_{kind}"
        ),
        rows("health", "component", "'score'", "score", "state", f"components_{kind}"),
        rows("health", "'total'", "'score'", "score", "risk", f"health_{kind}"),
        rows("finding", "finding", "'severity'", "NULL", "severity", f"findings_{kind}"),
        rows("action", "action", "'priority'", "NULL", "priority", f"actions_{kind}"),
        rows("limitation", "limitation", "'holds'", "NULL", "NULL", f"limits_{kind}"),
    ]
    if kind == "binary":
        parts.append(rows("calibration", "'brier'", "'delta'", "brier_delta", ASSESSED, "brier"))
        parts.append(rows("threshold", "printf('%.2f', threshold)", "'f1'", "f1", "NULL", "sweep"))
    return union(parts)


for kind in TASKS:
    oracle(f"full_analysis_{kind}", overview(kind))

QUALITY_OVERVIEW = f"""SELECT 'quality' AS section, "column" AS item, 'missing_delta' AS measure, {r6('missing_delta', 'value')}, status FROM """
DRIFT_OVERVIEW = f"SELECT 'drift', col, measure, {r6('score', 'value')}, status FROM drift_rows"
part("key_quality", quality_facts(["l_orderkey", "l_linenumber", *FEATURES, "y_true"], "y_true"))
STABILITY = f"SELECT 'health', component, 'score', {r6('score', 'value')}, state FROM components_binary WHERE component = 'stability'"
oracle("full_analysis_fitted", f"{QUALITY_OVERVIEW} key_quality UNION ALL {DRIFT_OVERVIEW} UNION ALL {STABILITY}")
part("logged_quality", quality_facts(["l_orderkey", "l_linenumber", *FEATURES, "y_true"], "y_true"))
ONLY_CURRENT = union([f"SELECT 'quality', '{c}', 'missing_delta', NULL, 'danger'" for c in ("pred", "proba")])
LOGGED_SEGMENTS = f"SELECT 'segment', period || '/' || segment_column || '/' || segment_group, 'recall', {r6('recall', 'value')}, status FROM seg_binary WHERE {CUR}"
LOGGED_SWEEP = f"SELECT 'threshold', printf('%.2f', threshold), 'f1', {r6('f1', 'value')}, NULL FROM sweep"
AFTER = f"SELECT 'performance', metric, 'after', {r6('after', 'value')}, NULL FROM perf_binary"
oracle(
    "full_analysis_logged_binary",
    f"{QUALITY_OVERVIEW} logged_quality UNION ALL {ONLY_CURRENT} UNION ALL {DRIFT_OVERVIEW} UNION ALL {AFTER} UNION ALL {LOGGED_SEGMENTS} UNION ALL {LOGGED_SWEEP} UNION ALL {STABILITY}",
)
# Without probabilities there is no log loss.
oracle("full_analysis_logged_multiclass", f"SELECT * FROM ({overview('multiclass')}) WHERE item <> 'log_loss'")
oracle("full_analysis_logged_regression", overview("regression"))
part("quality_features", quality_facts(FEATURES, "none"))
oracle(
    "full_analysis_unlabelled",
    f"SELECT *, 0::BIGINT AS n_results FROM ({QUALITY_OVERVIEW} quality_features UNION ALL {DRIFT_OVERVIEW})",
)
oracle(
    "analysis_profile",
    f"""SELECT period, n_rows, {n('7', 'n_columns')}, missing_cells, {n('n_rows - groups', 'duplicate_rows')}, n_positive FROM (
      SELECT period, count(*) AS n_rows, CAST(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in QUALITY)}) AS BIGINT) AS missing_cells,
        count(*) FILTER (y_true = 1) AS n_positive FROM scored GROUP BY 1)
    JOIN (SELECT period, count(*) AS groups FROM (SELECT DISTINCT period, {', '.join(QUALITY)} FROM scored) GROUP BY 1) USING (period)""",
)
oracle(
    "json_text",
    f"""SELECT 'performance' AS view, count(*) OVER () AS n, metric, {r6('before')}, {r6('after')}, NULL::DOUBLE AS score, NULL::VARCHAR AS risk FROM perf_binary
    UNION ALL SELECT 'health', 1, NULL, NULL, NULL, {r6('score')}, risk FROM health_binary""",
)
part(
    "single_log",
    """SELECT * EXCLUDE (period), CASE WHEN row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber)
       <= CAST(floor(count(*) OVER () * 0.6) AS BIGINT) THEN 'reference' ELSE 'current' END AS period FROM scored""",
)
# The whole overview, with another split of the log.
PARTS["dated"], PARTS["scored"] = PARTS["scored"], PARTS["single_log"].replace("FROM scored", "FROM dated")
oracle("full_analysis_single_table", overview("binary"))
PARTS["scored"] = PARTS.pop("dated")
