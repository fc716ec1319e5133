"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from lograil.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-9)) for p, q in zip(x, y)), (x, y)


def test_counts_of_detection_and_alerts(spark, sf_dir):
    assert catalog.queries()["q_detect"](spark, sf_dir).count() == 28
    assert catalog.queries()["q_alert_limit"](spark, sf_dir).count() > 0


def test_ranked_is_a_whole_sort(spark):
    from pyspark.sql import functions as F

    from lograil.operators import records

    rows = [(i * 7919 % 3001, i % 5 if i % 11 else None) for i in range(3000)]
    got = records.ranked(spark.createDataFrame(rows, "a int, b int"), F.col("b").desc_nulls_last(), F.col("a")).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["nth"])] == want and sorted(r["nth"] for r in got) == list(range(1, 3001))


def test_detect_reads_the_whole_table(spark, tmp_path):
    """Events from 1000 on have no time, so their csv lines lack a field: brute force over all lines."""
    from collections import Counter

    from lograil.plans.fixtures import event_lines

    cols = "event_id long, user_id long, event_type string, value double, ts timestamp, props string"
    spark.range(1200).selectExpr("id event_id", "id % 4 user_id", "'click' event_type", "1.5D value", "if(id < 1000, timestamp '2024-01-01', null) ts", "'{\"k\":1}' props").to(spark.createDataFrame([], cols).schema).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["source"]: r["score"] for r in catalog.queries()["q_detect"](spark, str(tmp_path)).collect() if r["source"].endswith(".csv")}
    shapes = {}
    for r in event_lines(spark, str(tmp_path), "csv").collect():
        shapes.setdefault(r["source"] + ".csv", Counter())[r["raw"].split('"')[0].count(",")] += 1
    assert got == {s: round(0.85 * max(c.values()) / sum(c.values()), 6) for s, c in shapes.items()} and len(got) == 4


def test_merge_numbers_events_in_many_tasks(spark, sf_dir):
    out = catalog.queries()["q_merge"](spark, sf_dir)
    assert "row_number" not in out._jdf.queryExecution().executedPlan().toString()


def test_encoded_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A table of several splits becomes several files in each encoding, and the result has a row for each encoding."""
    cols = "event_id long, user_id long, event_type string, value double, ts timestamp, props string"
    made = spark.range(0, 400, 1, 4).selectExpr("id event_id", "id % 4 user_id", "'click' event_type", "1.5D value", "timestamp '2024-01-01' ts", "'{\"k\":1}' props").to(spark.createDataFrame([], cols).schema)
    made.write.parquet(str(tmp_path / "events.parquet"))
    paths, own = [], catalog.own_path
    monkeypatch.setattr(catalog, "own_path", lambda s, name: paths.append(own(s, name)) or paths[-1])
    got = sorted((r["encoding"], r["line_ending"], r["n"], r["n_distinct"]) for r in catalog.queries()["q_encodings"](spark, str(tmp_path)).collect())
    assert got == [(e, "crlf", 400, 4) for e in ("ISO-8859-1", "UTF-16LE", "UTF-8")]
    assert all(len(spark.read.format("binaryFile").load(f"{p}/*.txt").select("path").collect()) > 1 for p in paths)


def test_stream_merge_takes_slices_of_several_files(spark, sf_dir, duck, monkeypatch):
    """All files of a slice are one batch, and no batch writes its lines again to tell final ones apart."""
    from lograil.streaming import merged

    batches, made = [], []
    step = merged.MergedView._step
    monkeypatch.setattr(catalog, "FILE_ROWS", 50)
    monkeypatch.setattr(merged, "materialize", lambda df, name, kept=merged.materialize: made.append(name) or kept(df, name))
    monkeypatch.setattr(merged.MergedView, "_step", lambda view, s, batch, k, now, final: batches.append(batch.count()) or step(view, s, batch, k, now, final))
    _, files = catalog._event_files(spark, sf_dir)
    got = [tuple(r) for r in catalog.queries()["q_stream_merge"](spark, sf_dir).orderBy("nth").collect()]
    want = duck.execute(catalog.oracle_sql()["q_stream_merge"] + " order by nth").fetchall()
    assert files > 1 and len(batches) == catalog.SLICES + 1 and batches[-1] == 0 and min(batches[:-1]) > 0
    assert got == want and set(made) == {"first"}
