"""Read-only SQL: the guard as a column over statements, and the guarded run."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone import fixed_values as fixed
from quillstone.functions.text import has_text

MUTATING = r"(?i)\b(" + "|".join(fixed.MUTATING_KEYWORDS) + r")\b"
DANGEROUS = (
    r"(?i)\b(" + "|".join([*fixed.DANGEROUS_FUNCTIONS, *fixed.JVM_FUNCTIONS]) + r")`?\s*\("
    r"|\b(" + "|".join(fixed.SYSTEM_CATALOGS) + r")\."
    r"|\b(" + "|".join(fixed.PATH_FORMATS) + r")`?\s*\.\s*`"
    # a path behind any name: readers may be named by class as well
    r"|\.\s*`[^`]*[/\\:][^`]*`"
)
COMMENT = r"--|/\*|\*/"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def sql_reject_reason(sql: Column | str) -> Column:
    """Why a statement may not run; null when it may. A query that starts with WITH is refused."""
    text = _trim(F.col(sql) if isinstance(sql, str) else sql)
    body = _trim(F.regexp_replace(text, r";\z", ""))
    reasons = fixed.SQL_REASONS
    return (
        F.when(~has_text(text), reasons["empty"])
        .when(F.rlike(text, F.lit(COMMENT)), reasons["comment"])
        .when(F.contains(body, F.lit(";")), reasons["multiple"])
        .when(~F.startswith(F.upper(body), F.lit("SELECT")), reasons["not_select"])
        .when(F.rlike(body, F.lit(MUTATING)), reasons["mutating"])
        .when(F.rlike(body, F.lit(DANGEROUS)), reasons["dangerous"])
    )


def check_sql(spark: SparkSession, sql: str | None) -> str | None:
    row = spark.createDataFrame([(sql,)], "sql string").select(sql_reject_reason("sql").alias("r"))
    return row.first().r


class SqlRejected(ValueError):
    pass


FILES = "spark.sql.runSQLOnFiles"


def guarded_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The whole result of an accepted statement; a refused one raises.

    While the statement is analysed, which is when its relations are looked up, no path counts as a relation.
    """
    reason = check_sql(spark, sql)
    if reason is not None:
        raise SqlRejected(reason)
    before = spark.conf.get(FILES)
    spark.conf.set(FILES, "false")
    try:
        return spark.sql(sql.strip().removesuffix(";"))
    finally:
        spark.conf.set(FILES, before)


def cell_truncate(df: DataFrame, limit: int = fixed.SQL_CELL_CHARS) -> DataFrame:
    """Every cell as text: null as NULL, long cells cut and marked."""

    def cell(field: T.StructField) -> Column:
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        text = F.to_json(field.name) if nested else F.col(f"`{field.name}`").cast("string")
        cut = F.concat(F.substring(text, 1, limit), F.lit(fixed.SQL_CELL_MARK))
        return F.when(text.isNull(), "NULL").when(F.length(text) > limit, cut).otherwise(text).alias(field.name)

    return df.select(*[cell(f) for f in df.schema])


def run_sql(
    spark: SparkSession,
    sql: str,
    max_rows: int = fixed.SQL_MAX_ROWS,
    timeout_seconds: float = fixed.SQL_TIMEOUT_SECONDS,
) -> tuple[list[str], list[tuple], str]:
    """(columns, rows as text, note) of a guarded statement: at most ``max_rows`` rows, within the time limit."""
    frame = cell_truncate(guarded_sql(spark, sql).limit(max_rows))
    tag = f"guarded-{uuid.uuid4().hex[:12]}"
    context = spark.sparkContext
    timer = threading.Timer(timeout_seconds, lambda: context.cancelJobsWithTag(tag))
    context.addJobTag(tag)
    timer.start()
    try:
        rows = [tuple(r) for r in frame.collect()]
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return frame.columns, rows, fixed.SQL_LIMIT_NOTE if len(rows) >= max_rows else ""
