from pyspark.sql import functions as F

from lograil.functions import predicates as P
from lograil.streaming import live


def run(df, name, mode="append", ends=True):
    """A query with idle timers never ends by itself, so it is stopped after its first batches."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name)
    q = (writer.trigger(availableNow=True) if ends else writer.trigger(processingTime="1 second")).start()
    q.awaitTermination(60 if ends else 15)
    q.stop()


def test_live_filter_and_alerts(spark, tmp_path):
    rows = [("s", i, "error" if i % 3 == 0 else "ok", i * 1_000_000) for i in range(30)]
    spark.createDataFrame(rows, "source string, line_no long, raw string, us long").write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("source string, line_no long, raw string, us long").parquet(str(tmp_path / "in"))
    run(live.live_filter(lines, P.text(F.col("raw"), "error")), "hits")
    assert spark.table("hits").count() == 10
    run(live.live_counts(lines, P.text(F.col("raw"), "error")), "counts", "complete")
    assert spark.table("counts").first()["n"] == 10
    hits = live.live_filter(lines, P.text(F.col("raw"), "error")).select("source", F.lit("r").alias("rule"), F.timestamp_micros("us").alias("ts"))
    run(live.live_alerts(hits, 5), "alerts", ends=False)
    assert spark.table("alerts").filter("suppressed = 0").count() >= 1
    run(live.live_records(lines, P.text(F.col("raw"), "error")), "recs", ends=False)
    assert spark.table("recs").filter("n_lines = 3").count() >= 9


def test_live_context_and_merge_equal_the_batch_operators(spark, tmp_path):
    from lograil.operators import records

    rows = [(f"s{k}", g, i, f"{'hit' if (i * 7 + k) % 11 == 0 else 'line'} {i}", None if i % 4 == 3 else (i * 3 + k - 20 * (i % 7 == 0)) * 1_000_000) for k in range(3) for g in (0, 1) for i in range(40)]
    cols = "source string, gen int, line_no long, raw string, us long"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame([r for r in rows if r[1] == 1], cols)
    one = spark.readStream.schema(cols).parquet(str(tmp_path / "in")).filter("gen = 1")
    run(live.live_context(one, P.text(F.col("raw"), "hit"), 2, 1), "context")
    key = lambda df: sorted((r["source"], r["line_no"], r["is_context"]) for r in df.collect())
    assert key(spark.table("context")) == key(records.with_context(batch, P.text(F.col("raw"), "hit"), 2, 1))
    timed = live.live_effective_time(one, F.timestamp_micros("us"))
    run(timed, "timed")
    want = records.effective_time(batch, F.timestamp_micros("us"), 8)
    assert sorted((r["source"], r["line_no"], r["eff_us"]) for r in spark.table("timed").collect()) == sorted((r["source"], r["line_no"], r["u"]) for r in want.select("source", "line_no", F.unix_micros("eff_ts").alias("u")).collect())
    got = live.emit_final([[5, "a", 0, ""], [3, "b", 0, ""], [9, "a", 1, ""]], {"a": (9, 0), "b": (3, 0), "c": (4, 900)}, 1000, 500)
    assert [x[:2] for x in got[0]] == [[3, "b"]] and [x[:2] for x in got[1]] == [[5, "a"], [9, "a"]]
    got = live.emit_final([[5, "a", 0, ""], [3, "b", 0, ""], [9, "a", 1, ""]], {"a": (9, 0), "b": (3, 0), "c": (4, 400)}, 1000, 500)
    assert [x[0] for x in got[0]] == [3, 5, 9] and got[1] == []
    spark.createDataFrame([(r["source"], r["line_no"], r["raw"], r["eff_us"]) for r in spark.table("timed").collect()], "source string, line_no long, raw string, eff_us long").coalesce(1).write.parquet(str(tmp_path / "eff"))
    run(live.live_merge(spark.readStream.schema("source string, line_no long, raw string, eff_us long").parquet(str(tmp_path / "eff"))), "merged", ends=False)
    merged = [(r["source"], r["line_no"]) for r in spark.table("merged").collect()]
    assert merged == [(r["source"], r["line_no"]) for r in records.merged(want).collect()] and spark.table("merged").filter("late").count() == 0


def test_new_generation_starts_records_anew(spark, tmp_path):
    rows = [("s", 0, 0, "start a"), ("s", 0, 1, "more"), ("s", 1, 0, "tail of nothing"), ("s", 1, 1, "start b")]
    spark.createDataFrame(rows, "source string, gen int, line_no long, raw string").write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("source string, gen int, line_no long, raw string").parquet(str(tmp_path / "in"))
    run(live.live_records(lines, P.text(F.col("raw"), "start")), "by_gen", ends=False)
    assert sorted((r["gen"], r["rec_id"], r["body"]) for r in spark.table("by_gen").collect()) == [(0, 0, "start a\nmore"), (1, 1, "start b")]
