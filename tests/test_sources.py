"""Sinks refuse to overwrite, appends are idempotent, feeds keep their order."""

import pytest
from pyspark.sql import functions as F

from evenkeel.sources import pages as P
from evenkeel.sources import tables as S


def test_write_table_refuses_overwrite_and_keeps_order(spark, tmp_path):
    df = spark.range(100).withColumn("k", 99 - F.col("id"))
    path = str(tmp_path / "out")
    S.write_table(df, path, ["k", "id"], ["k"], parts=4)
    parts = sorted((tmp_path / "out").glob("part-*.parquet"))
    seen = [r.k for p in parts for r in spark.read.parquet(str(p)).collect()]
    assert seen == list(range(100))
    with pytest.raises(Exception, match="(?i)already exists"):
        S.write_table(df, path, ["k", "id"], ["k"])
    with pytest.raises(ValueError, match="missing columns"):
        S.write_table(df, str(tmp_path / "o2"), ["nope"], ["k"])


RESULT = "job_id string, s double"


def test_append_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    plan = spark.createDataFrame([(f"j{i}",) for i in range(6)], "job_id string")
    S.append_results(plan, spark.createDataFrame([("j0", 1.0)], RESULT), path)
    fresh = spark.createDataFrame([("j0", 9.0), ("j1", 2.0), ("j1", 3.0), ("jX", 4.0)], RESULT)
    assert S.append_results(plan, fresh, path) == {"before": 1, "new": 1, "after": 2, "pending": 4}
    assert S.append_results(plan, fresh, path) == {"before": 2, "new": 0, "after": 2, "pending": 4}
    assert sorted(map(tuple, S.read_results(spark, path, RESULT).collect())) == [("j0", 1.0), ("j1", 2.0)]


def test_two_runs_append_the_same_jobs_and_one_dies(spark, tmp_path):
    """Both choose their rows before either has committed; a third never commits: each job is there once, from the run that came first."""
    path = f"file://{tmp_path}/r"
    plan = spark.createDataFrame([(f"j{i}",) for i in range(5)], "job_id string")
    results = lambda s, jobs: spark.createDataFrame([(j, s) for j in jobs], RESULT)
    first = S.stage_results(plan, results(1.0, ["j0", "j1"]), path)
    dead = S.stage_results(plan, results(7.0, ["j0", "j3", "j4"]), path)
    second = S.stage_results(plan, results(2.0, ["j1", "j2"]), path)
    assert S.read_results(spark, path, RESULT).count() == 0
    S.commit_results(spark, first, RESULT)
    told = S.commit_results(spark, second, RESULT)
    assert told.run != second.run and len(S.committed_runs(spark, path)) == 2 and dead.run not in S.committed_runs(spark, path)
    assert sorted(map(tuple, S.read_results(spark, path, RESULT).collect())) == [("j0", 1.0), ("j1", 1.0), ("j2", 2.0)]
    assert S.append_results(plan, results(3.0, ["j0", "j3", "j4"]), path) == {"before": 3, "new": 2, "after": 5, "pending": 0}


def test_a_taken_commit_number_is_not_overwritten(spark, tmp_path, monkeypatch):
    """The other run commits between the look at the commits and the rename."""
    path = str(tmp_path / "r")
    plan = spark.createDataFrame([("j0",), ("j1",)], "job_id string")
    mine = S.stage_results(plan, spark.createDataFrame([("j0", 1.0), ("j1", 1.0)], RESULT), path)
    other = S.stage_results(plan, spark.createDataFrame([("j0", 2.0)], RESULT), path)
    look, seen = S.committed_runs, []

    def late(s, p):
        found = look(s, p)
        if not seen:
            seen.append(1)
            S.commit_results(s, other, RESULT)
        return found

    monkeypatch.setattr(S, "committed_runs", late)
    S.commit_results(spark, mine, RESULT)
    assert sorted(map(tuple, S.read_results(spark, path, RESULT).collect())) == [("j0", 2.0), ("j1", 1.0)]


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"response": {"docs": [{"bibcode": "B1", "title": ["A  b"]}, {"id": "7", "doi": ["10.1/x"]}]}}')
    pages = P.read_pages(spark, str(tmp_path)).select(F.lit("q").alias("query"), F.lit(1).alias("page"), "body")
    got = P.ledger(P.json_hits(pages)).orderBy("source_rank").collect()
    assert [(r.record_id, r.title, r.source_rank, r.raw_hit_id) for r in got] == [("B1", "A b", 1, "H000001"), ("7", "", 2, "H000002")]
