"""Diffs, logs, repositories and streams."""

import subprocess

import pytest
from pyspark.sql import functions as F

from credsieve.operators import metrics
from credsieve.plans.engine import Engine
from credsieve.sources import diffs, inputs
from credsieve.streaming import streams

DIFF = """diff --git a/old.py b/new.py
similarity index 90%
rename from old.py
rename to new.py
--- a/old.py
+++ b/new.py
@@ -1,3 +1,4 @@
 one
-two
+TWO
+THREE

+after blank
@@ -20 +22 @@ def f
-x
+y
\\ No newline at end of file
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/p.png b/p.png
Binary files a/p.png and b/p.png differ
diff --cc merged.py
index 1,2..3
--- a/merged.py
+++ b/merged.py
@@@ -1,2 -1,2 +1,3 @@@
  both
++new in merge
+ from one
"""


def test_diffs(spark):
    df = spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "diff_id long, diff string")
    rows = [(r["path"], r["number"], r["text"]) for r in diffs.added_lines(df).orderBy("pos").collect()]
    assert rows == [("new.py", 2, "TWO"), ("new.py", 3, "THREE"), ("new.py", 5, "after blank"), ("new.py", 22, "y"), ("merged.py", 2, "new in merge")]
    units = {r["path"]: (r["text"], r["numbers"]) for r in inputs.diff_units(df).collect()}
    assert units["new.py"] == ("TWO\nTHREE\nafter blank\ny", [2, 3, 5, 22])


def test_ranges_of_revisions(spark):
    table = {"main": True, "a..b": True, "v1.0...HEAD~2": True, "--output=x": False, "a b": False, "": False}
    df = spark.createDataFrame([(k,) for k in table], "r string")
    assert {r[0]: r[1] for r in df.select("r", diffs.is_range(F.col("r"))).collect()} == table


@pytest.fixture
def repository(tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@example.org", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.conf").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "a.conf").write_text('x = 1\npassword = "tr0ub4dor"\n')
    git("commit", "-qam", "second")
    (tmp_path / "b.conf").write_text('password = "untr4cked"\n')
    (tmp_path / "c.conf").write_text('password = "st4gedvalue"\n')
    git("add", "c.conf")
    return str(tmp_path)


def test_repositories(spark, repository):
    engine = Engine(spark)
    history = engine.scan_history(repository).kept.collect()
    assert [(r["file"], r["line"], r["author"], r["message"]) for r in history] == [("a.conf", 2, "a", "second")]
    assert {r["secret"] for r in engine.scan_staged(repository).kept.collect()} == {"st4gedvalue"}
    assert {r["secret"] for r in engine.scan_uncommitted(repository).kept.collect()} == {"st4gedvalue", "untr4cked"}
    assert {r["secret"] for r in engine.scan_range(repository, "HEAD~1..HEAD").kept.collect()} == {"tr0ub4dor"}
    assert inputs.tracked_files(repository) == ["a.conf", "c.conf"]
    with pytest.raises(ValueError):
        engine.scan_range(repository, "--output=x")


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("FilePath,LineStart,LineEnd,GroundTruth\na,1,2,F\na,1,2,t\nb,3,3,X\n")
    assert {tuple(r) for r in inputs.labels(spark, str(tmp_path / "l.csv")).collect()} == {("a", 1, 2, "T"), ("b", 3, 3, "X")}
    (tmp_path / "g.csv").write_text("# file, risk, info\na,1,0\n")
    assert [tuple(r) for r in inputs.ground_truth(spark, str(tmp_path / "g.csv")).collect()] == [("a", 1, 0)]


def test_metrics_on_known_cases(spark):
    rows = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.8, True)], "score double, positive boolean")
    assert metrics.auc(rows).first()[0] == pytest.approx(0.875)
    assert tuple(metrics.false_positives_at(rows, 1.0).first()) == (0.4, 1)
    low, high = metrics.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (round(r[0], 3), round(r[1], 3)) == (0.490, 0.943)
    sample = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "s string, v double")
    sizes = spark.createDataFrame([("a", 30), ("b", 10)], "s string, size long")
    assert metrics.stratified_estimate(sample, sizes, "s", "v").first()[0] == pytest.approx(0.625)


def run_stream(df, mode, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(k, "a.conf", f'password = "tr0ub4dor{k % 2}"' if k % 3 else "nothing", f"2024-01-01 00:{k:02d}:00") for k in range(12)]
    made = spark.createDataFrame(rows, "k int, path string, text string, at string").selectExpr("cast(k as string) AS unit_id", "path", "text", "cast(null as array<int>) AS numbers", "timestamp(at) AS ts")
    made.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(made.schema).parquet(folder)
    found = run_stream(streams.stream_findings(stream), "append", tmp_path, "found")
    assert len(found) == 8
    timed = stream.withColumn("fingerprint", F.sha2("text", 256))
    assert len(run_stream(streams.deduplicated(timed.where("text like 'pass%'")), "append", tmp_path, "once")) == 2
    counts = run_stream(streams.tumbling(stream, "5 minutes", late="1 minute"), "complete", tmp_path, "windows")
    assert sorted(r["n"] for r in counts) == [2, 5, 5]
    assert len(run_stream(streams.sessions(stream, "90 seconds", "path"), "complete", tmp_path, "sessions")) == 1


def test_remembered_verdicts(spark, tmp_path):
    folder = str(tmp_path / "verdicts")
    rows = [("a", "uncertain", 0.4), ("b", "secret", 0.9), ("b", "secret", 0.8), ("a", "uncertain", 0.4)]
    made = spark.createDataFrame(rows, "cache_key string, status string, confidence double")
    made.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(made.schema).parquet(folder)
    found = run_stream(streams.remembered(stream), "append", tmp_path, "remembered")
    assert sorted((r["cache_key"], r["confidence"], r["hit"]) for r in found) == [("a", 0.4, False), ("a", 0.4, False), ("b", 0.9, False), ("b", 0.9, True)]
