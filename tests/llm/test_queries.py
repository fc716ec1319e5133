"""Queries on the smallest tables: SQL where there is some, held-out accuracy for what is learned, and the pipeline stage by stage."""

import duckdb
import pytest

from lograil.llm import queries

TABLES = ("documents", "labels", "pages")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    rows = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x).values.tolist()))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_language_accuracy(spark, sf_dir):
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = queries.op10_language(spark, sf_dir).filter("held_out").join(lang, "doc_id")
    assert out.filter("lang = lang_pred").count() >= 0.9 * out.count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C
    from lograil.llm import line_dedup, mixing, near_dedup
    from lograil.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = materialize(C.drop_toxic(spark, docs, sf_dir), "t1")
    assert 0.8 * docs.count() <= kept.count() <= docs.count() and kept.columns == docs.columns
    lines = materialize(C.drop_repeated_lines(spark, kept, sf_dir), "t2")
    assert lines.count() == kept.count() and line_dedup.dropped_lines(lines).count() == 0
    near = materialize(C.drop_near_copies(spark, lines, sf_dir), "t3")
    assert near.count() == near_dedup.near_groups(lines, 5, 80).filter("kept").count()
    mixed = materialize(C.mix_sources(spark, near, sf_dir), "t4")
    assert mixed.count() == mixing.mix(near).agg({"times": "sum"}).first()[0]
    packed = C.pack_sequences(spark, mixed, sf_dir)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    full = packed.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert full.max() <= 2048 and len(full) <= 1.05 * -(-full.sum() // 2048)
