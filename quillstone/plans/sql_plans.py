"""Queries through the SQL guard: its audit, and relational coverage over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.operators import guard
from quillstone.plans import duck
from quillstone.plans.inputs import derived, duck_select
from quillstone.plans.registry import query
from quillstone.sources.tables import table

# Orders as a log of statements, of every kind that the guard has to judge.
STATEMENT = [
    "o_orderkey AS stmt_id",
    "CASE o_orderkey % 15 WHEN 0 THEN '  ' WHEN 1 THEN 'SELECT ' || CAST(o_custkey AS STRING) || ' -- note' "
    "WHEN 2 THEN 'select ' || CAST(o_custkey AS STRING) || '; SELECT 2' WHEN 3 THEN 'WITH a AS (SELECT 1) SELECT * FROM a' "
    "WHEN 4 THEN ' Select updated_at FROM t' || CAST(o_custkey AS STRING) || ' ; ' WHEN 5 THEN 'DELETE FROM agent;' "
    "WHEN 6 THEN 'SELECT ''update''' WHEN 7 THEN 'SELECT pg_read_file (''/etc/passwd'')' WHEN 8 THEN 'SELECT * FROM information_schema.tables' "
    "WHEN 9 THEN 'SELECT /* x */ 1' WHEN 10 THEN 'SELECT current_setting_of FROM locks' WHEN 11 THEN NULL "
    "WHEN 12 THEN 'SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hostname`' "
    "WHEN 13 THEN 'SELECT * FROM a.b.c . `file:x` JOIN t' ELSE 'SELECT o FROM ' || o_orderpriority END AS sql",
]


@query(
    "sql_guard",
    f"""
    WITH s AS ({duck_select(STATEMENT, 'orders')}),
    t AS (SELECT *, trim(coalesce(sql, '')) AS x FROM s), b AS (SELECT *, trim(regexp_replace(x, ';$', '')) AS y FROM t)
    SELECT stmt_id, CASE WHEN x = '' THEN {duck.text(fixed.SQL_REASONS['empty'])} WHEN regexp_matches(x, '--|/\\*|\\*/') THEN {duck.text(fixed.SQL_REASONS['comment'])}
      WHEN contains(y, ';') THEN {duck.text(fixed.SQL_REASONS['multiple'])} WHEN NOT starts_with(upper(y), 'SELECT') THEN {duck.text(fixed.SQL_REASONS['not_select'])}
      WHEN regexp_matches(y, {duck.text(guard.MUTATING)}) THEN {duck.text(fixed.SQL_REASONS['mutating'])}
      WHEN regexp_matches(y, {duck.text(guard.DANGEROUS)}) THEN {duck.text(fixed.SQL_REASONS['dangerous'])} END AS reject_reason FROM b
    """,
)
def sql_guard(spark, folder):
    log = derived(table(spark, folder, "orders"), STATEMENT)
    return log.select("stmt_id", guard.sql_reject_reason("sql").alias("reject_reason"))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def _run(spark, folder, sql):
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)
    return guard.guarded_sql(spark, sql)


def _passthrough(name: str, sql: str, duck_sql: str | None = None) -> None:
    """The same statement in both engines, or its DuckDB spelling where a function has another name."""

    @query(name, duck_sql or sql)
    def run(spark, folder):
        return _run(spark, folder, sql)


_passthrough(
    "run_sql_scan_filter",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.03 AND 0.06 "
    "AND l_quantity >= 20 AND NOT l_linestatus = 'F' AND l_shipdate IS NOT NULL",
)
_passthrough(
    "run_sql_join",
    "SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AMERICA') OR r_name IS NULL GROUP BY n_name, o_orderpriority",
)
_passthrough(
    "run_sql_semi_anti_join",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000) "
    "AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
_passthrough(
    "run_sql_agg",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, "
    "min(l_tax) AS min_tax, max(l_tax) AS max_tax, count(*) AS rows_count, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1",
)
_passthrough(
    "run_sql_rollup",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
)
_passthrough(
    "run_sql_cube",
    "SELECT p_brand, p_size % 5 AS size_class, count(*) AS parts, grouping(p_brand) + 0 AS all_brands FROM part GROUP BY CUBE (p_brand, p_size % 5)",
    "SELECT p_brand, p_size % 5 AS size_class, count(*) AS parts, (grouping(p_brand) + 0)::INTEGER AS all_brands FROM part GROUP BY CUBE (p_brand, p_size % 5)",
)
_passthrough("run_sql_distinct", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
_passthrough(
    "run_sql_window",
    "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) + 0 AS price_rank, "
    "round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change, "
    "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders",
    "SELECT o_custkey, o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC))::INTEGER AS price_rank, "
    "round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change, "
    "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders",
)
_passthrough(
    "run_sql_topk",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5",
)
_passthrough(
    "run_sql_setops",
    "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier",
    "(SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) EXCEPT SELECT s_suppkey FROM supplier",
)
_passthrough("run_sql_intersect", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 20")
_passthrough(
    "run_sql_subquery",
    "SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand) "
    "AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)",
)
_passthrough(
    "run_sql_derived_table",
    "SELECT bucket, count(*) AS customers FROM (SELECT o_custkey, count(*) AS bucket FROM orders GROUP BY o_custkey) t GROUP BY bucket",
)
_passthrough(
    "run_sql_json",
    "SELECT event_type, CAST(get_json_object(props, '$.k') AS INT) % 10 AS slot, count(*) AS n FROM events GROUP BY event_type, CAST(get_json_object(props, '$.k') AS INT) % 10",
    "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS slot, count(*) AS n FROM events GROUP BY ALL",
)
_passthrough(
    "run_sql_datetime",
    "SELECT date_format(ts, 'yyyy-MM-dd') AS day, hour(ts) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= '2024-01-10 00:00:00' GROUP BY date_format(ts, 'yyyy-MM-dd'), hour(ts)",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INTEGER AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= '2024-01-10 00:00:00' GROUP BY ALL",
)
_passthrough(
    "run_sql_conditional",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, "
    "CAST(c_acctbal AS INT) IS NOT NULL AS known FROM customer",
)
_passthrough(
    "run_sql_arrays",
    "SELECT source, size(collect_set(lang)) AS languages, array_join(sort_array(collect_set(lang)), ',') AS listed FROM documents GROUP BY source",
    "SELECT source, count(DISTINCT lang)::INTEGER AS languages, string_agg(DISTINCT lang, ',' ORDER BY lang) AS listed FROM documents GROUP BY source",
)


REPORT = "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber"


@query(
    "run_sql",
    f"SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_extendedprice::VARCHAR AS l_extendedprice FROM ({REPORT} LIMIT 100)",
)
def run_sql(spark, folder):
    """A report of at most 100 rows as text, as the tool hands it out, within its time limit."""
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)
    columns, rows, _ = guard.run_sql(spark, REPORT)
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


@query(
    "cell_truncate",
    f"SELECT doc_id::VARCHAR AS doc_id, coalesce(nullif(lang, 'de'), 'NULL') AS lang, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '{fixed.SQL_CELL_MARK}' ELSE text END AS text FROM documents",
)
def cell_truncate(spark, folder):
    return guard.cell_truncate(_run(spark, folder, "SELECT doc_id, nullif(lang, 'de') AS lang, text FROM documents"))
