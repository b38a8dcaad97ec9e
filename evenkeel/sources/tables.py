"""Typed scans, profiles, inventories and sinks for tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.numeric import finite_or_null
from evenkeel.functions.text import blank_to_null, parse_flag
from evenkeel.operators.quality import table_fingerprint
from evenkeel.plans.expansion import pending

INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def scan(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read a headed text table with declared types.

    Text is trimmed, blank is NULL, booleans accept any case, non-finite numbers become NULL.
    Parquet already has types and is only narrowed to the declared columns.
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path).select(*schema.names)
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.schema(raw).option("header", True).option("mode", "FAILFAST").option("escape", '"').csv(path)
    return rows.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields])


def _typed(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return parse_flag(x)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite_or_null(blank_to_null(x).cast(kind))
    return blank_to_null(x).cast(kind)


def profile_types(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column_order, column, type) with type integer, decimal, string or empty; one pass per table."""
    parts = []
    for name, df in tables.items():
        x = lambda c: F.trim(F.col(c).cast("string"))
        counts = [F.struct(
            F.count_if(x(c) != "").alias("full"),
            F.count_if((x(c) != "") & ~x(c).rlike(INTEGER)).alias("not_int"),
            F.count_if((x(c) != "") & ~x(c).rlike(DECIMAL)).alias("not_dec")).alias(f"_{i}")
            for i, c in enumerate(df.columns)]
        rows = F.array(*[F.struct(F.lit(i + 1).alias("column_order"), F.lit(c).alias("column"), F.col(f"_{i}").alias("s"))
                         for i, c in enumerate(df.columns)])
        one = df.agg(*counts).select(F.explode(rows).alias("r"))
        kind = (F.when(F.col("r.s.full") == 0, "empty").when(F.col("r.s.not_int") == 0, "integer")
                .when(F.col("r.s.not_dec") == 0, "decimal").otherwise("string"))
        parts.append(one.select(F.lit(name).alias("table"), F.col("r.column_order").alias("column_order"),
                                F.col("r.column").alias("column"), kind.alias("type")))
    return reduce(DataFrame.unionByName, parts)


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count, column count and content fingerprint per table."""
    parts = [table_fingerprint(df).select(
        F.lit(name).alias("table"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), "content_sum")
        for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def write_table(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], parts: int | None = None,
                fmt: str = "parquet") -> None:
    """Publish a table once: declared columns, range-sorted by ``order``, refusing to overwrite.

    Files are range-partitioned and sorted inside, so reading them in name order gives the total
    order without a single-task sort; the job commit makes the table appear as a whole.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    keys = [F.col(c) for c in order]
    out = df.select(*columns)
    out = out.repartitionByRange(parts, *keys) if parts else out.repartitionByRange(*keys)
    out.sortWithinPartitions(*keys).write.mode("errorifexists").format(fmt).save(path)


# --- results that many runs append to -------------------------------------------------------------
# ``<path>/runs/<run>`` holds the rows of a run, ``<path>/commits/<number>`` names the runs that count, in order.

@dataclass(frozen=True)
class StagedRun:
    """Rows of a run that are written but do not count yet; ``seen`` commits were known when they were chosen."""

    path: str
    run: str
    seen: int
    key: str


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that count, in the order of their commits."""
    where, fs = _at(spark, f"{path}/commits")
    if not fs.exists(where):
        return []
    out = []
    for status in sorted(fs.listStatus(where), key=lambda s: s.getPath().getName()):
        if status.getPath().getName().isdigit():
            stream = fs.open(status.getPath())
            out.append(stream.readUTF())
            stream.close()
    return out


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, runs: Sequence[str] | None = None) -> DataFrame:
    """Rows of the committed runs (or of ``runs``); what a run has left behind without a commit is not read."""
    runs = committed_runs(spark, path) if runs is None else runs
    return spark.read.schema(schema).parquet(*[f"{path}/runs/{r}" for r in runs]) if runs else spark.createDataFrame([], schema)


def stage_results(plan: DataFrame, fresh: DataFrame, path: str, key: str = "job_id") -> StagedRun:
    """Write the results of jobs that are planned and not yet committed; repeated fresh rows of one job are reduced to one."""
    spark, run = fresh.sparkSession, uuid.uuid4().hex
    runs = committed_runs(spark, path)
    rest = [c for c in fresh.columns if c != key]
    once = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*fresh.columns)
    new = pending(once.join(plan.select(key).distinct(), key, "left_semi"), read_results(spark, path, fresh.schema, runs), key)
    new.write.parquet(f"{path}/runs/{run}")
    return StagedRun(path, run, len(runs), key)


def commit_results(spark: SparkSession, staged: StagedRun, schema: T.StructType | str) -> StagedRun:
    """Make a staged run count, each job at most once whatever other runs have committed meanwhile.

    A commit is a file under the next number, put there by a rename that fails if the number is taken. Then, as whenever other
    runs have been committed since the rows were chosen, the jobs of those runs are taken out and the next number is tried. A
    run that dies before its rename leaves no trace in what is read.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    while True:
        runs = committed_runs(spark, staged.path)
        if len(runs) > staged.seen:
            rows = pending(read_results(spark, staged.path, schema, [staged.run]), read_results(spark, staged.path, schema, runs[staged.seen:]), staged.key)
            again = StagedRun(staged.path, uuid.uuid4().hex, len(runs), staged.key)
            rows.write.parquet(f"{staged.path}/runs/{again.run}")
            staged = again
            continue
        draft, fs = _at(spark, f"{staged.path}/drafts/{staged.run}")
        number, _ = _at(spark, f"{staged.path}/commits/{staged.seen:08d}")
        stream = fs.create(draft, True)
        stream.writeUTF(staged.run)
        stream.close()
        fs.mkdirs(number.getParent())
        how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, number, how)
            return staged
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise


def append_results(plan: DataFrame, fresh: DataFrame, path: str, key: str = "job_id") -> dict[str, int]:
    """Append each planned job's result exactly once; rows already committed or not planned are left out.

    Counts before, new, after and pending are returned, as a resumable run reports them.
    """
    spark = plan.sparkSession
    jobs = lambda: read_results(spark, path, fresh.schema).select(key).distinct().count()
    before = jobs()
    commit_results(spark, stage_results(plan, fresh, path, key), fresh.schema)
    after = jobs()
    total = plan.select(key).distinct().count()
    return {"before": before, "new": after - before, "after": after, "pending": total - after}
