from pyspark.sql import functions as F

from lograil.functions import kinds, times
from lograil.functions import predicates as P
from lograil.operators import detect, ingest, records, rules, sinks
from lograil.sources import lines as sources


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_levels(spark):
    for text, rank in (("W", 3), ("[warning]", 3), (" Error ", 4), ("informational", None), ("", None), ("panic", 5), (None, None)):
        assert one(spark, text, kinds.level_rank) == rank


def test_quantities(spark):
    for text, ns in (("250ms", 2.5e8), ("1.5s", 1.5e9), ("-2 h", -7.2e12), ("300", 3e8), ("5MB", None), ("x", None), ("1d", 8.64e13)):
        assert one(spark, text, kinds.duration_ns) == ns
    assert one(spark, "1.5KiB", kinds.size_bytes) == 1536.0
    assert one(spark, "1,234.5ms", lambda c: kinds.number(c, lenient=True)) == 1234.5
    assert one(spark, "inf", kinds.number) is None
    assert one(spark, "1d", kinds.number) is None


def test_shown(spark):
    for ns, text in (("850", "850 ns"), ("1500000", "1.5 ms"), ("2250000000", "2.25 s"), ("185000000000", "3m 5s"), ("7380000000000", "2h 3m")):
        assert one(spark, ns, lambda c: kinds.show_duration(c.cast("double"))) == text
    assert one(spark, "1536", lambda c: kinds.show_bytes(c.cast("double"))) == "1.5 KiB"
    assert one(spark, "-3725000000", lambda c: times.show_relative(c.cast("long"))) == "-1h02m"


def test_names():
    assert kinds.find_column(["severity", "x"], "level") == "severity"
    assert kinds.unique_names(["a", "", "a"]) == ["a", "col2", "a_2"]
    assert kinds.ordered_columns(["a", "b", "c"], ["c", "*", "a"]) == ["c", "b", "a"]


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([("500", "300"), (None, None), ("200", "1s")], "status string, dur string")
    assert df.filter(P.not_(P.equals(F.col("status"), "200", "number"))).count() == 2
    assert df.filter(P.compare(F.col("dur"), ">", "250ms", "duration")).count() == 2
    assert df.filter(P.compare(F.col("dur"), ">", "5MB", "duration")).count() == 0


def test_ansi(spark):
    assert one(spark, "\x1b[31mred\x1b[0m \x1b]0;title\x07x", kinds.strip_ansi) == "red x"


def test_timestamps(spark):
    for text in ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "02/Jan/2024:03:04:05 +0000", "1704164645", "1704164645000", "2024-01-02T04:04:05+01:00"):
        assert one(spark, text, lambda c: F.unix_seconds(times.cell_instant(c))) == 1704164645, text
    assert one(spark, "2024-13-02 03:04:05", times.cell_instant) is None
    assert one(spark, "x [2024-01-02 03:04:05,250] y", lambda c: F.unix_millis(times.line_instant(c))) == 1704164645250


def test_logfmt_edges(spark):
    m = one(spark, r'a=1 flag b="x \"q\" y=2" a=3 =z c=', ingest.logfmt_pairs)
    assert m["a"] == "1" and m["flag"] == "true" and m["b"] == 'x "q" y=2' and "" not in m


def test_delimited_rejects_other_counts(spark):
    df = spark.createDataFrame([("a,b",), ('1,"x, ""y"""',), ("1",), ("1,2,3",), ("",)], "raw string")
    out = [(r["is_record"], r["b"]) for r in ingest.delimited(df, ["a", "b"]).collect()]
    assert out == [(False, None), (True, 'x, "y"'), (False, None), (False, None), (False, None)]


def test_nested_json(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":[1,2]},"n":null}',), ("[1]",), ("{bad",)], "raw string")
    out = ingest.json_lines(df, ["a.b"], 2).collect()
    assert [r["is_record"] for r in out] == [True, False, False]
    assert out[0]["a.b"] == "1" and out[0]["extra"] == {"a.c": "[1,2]"}


def test_numbered_lines_over_splits(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "a.log").write_bytes(("\r\n".join(want)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = sources.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["raw"] for r in got] == want and [r["line_no"] for r in got] == list(range(3000))
    assert got[2]["byte_off"] == len(want[0]) + len(want[1]) + 4


def test_encodings(spark, tmp_path):
    for name, data in (("u16", "hällo\nyou\n".encode("utf-16-le")), ("lat", "hällo\n".encode("latin-1")), ("utf", "hällo\r\n".encode())):
        (tmp_path / name).write_bytes(data)
    got = {r["source"].rsplit("/", 1)[1]: (r["encoding"], r["line_ending"]) for r in sources.encodings(spark, str(tmp_path)).collect()}
    assert got["u16"][0] == "UTF-16LE" and got["lat"][0] == "ISO-8859-1" and got["utf"] == ("UTF-8", "crlf")
    # Lines of splits come in any order; their numbers are exact.
    assert sorted((r["line_no"], r["raw"]) for r in sources.read_encoded(spark, str(tmp_path / "u16"), "UTF-16LE").collect()) == [(0, "hällo"), (1, "you")]


def test_encodings_of_cut_samples(spark, tmp_path):
    """A letter or a line end that the end of the sample goes through does not count, in files longer than the sample only."""
    n = sources.SAMPLE_BYTES
    files = {f"{i}-{c}": (b"x" * (n - i) + c.encode() + b"\nend\n", "UTF-8", "lf") for c in "é✓😀" for i in range(1, 4)}
    files |= {"crlf": (b"x" * (n - 1) + b"\r\nend\r\n", "UTF-8", "lf"), "cr": (b"a\r" + b"x" * n, "UTF-8", "cr"), "wide": (("x" * (n // 2 - 1) + "\r\nend").encode("utf-16-le"), "UTF-16LE", "lf")}
    files |= {"latin": (b"\xe9 " + b"x" * n, "ISO-8859-1", "lf"), "surrogate": (b"x" * (n - 2) + b"\xed\xa0\x80", "ISO-8859-1", "lf"), "last": (b"x" * (n - 1) + b"\x80\n", "ISO-8859-1", "lf"), "whole": (b"x" * (n - 1) + b"\xe9", "ISO-8859-1", "lf")}
    for name, (data, _, _) in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["source"].rsplit("/", 1)[1]: (r["encoding"], r["line_ending"]) for r in sources.encodings(spark, str(tmp_path)).collect()}
    from urllib.parse import unquote

    assert {unquote(k): v for k, v in got.items()} == {k: v[1:] for k, v in files.items()}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(True, ' a,"b" ', None), (True, "x", "y")], "is_record boolean, a string, b string")
    sinks.write_csv(df, str(tmp_path / "out"), ["a", "b"])
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert sorted((r["a"], r["b"]) for r in back.collect()) == [(' a,"b" ', None), ("x", "y")]


def test_sort_keeps_continuations(spark):
    df = spark.createDataFrame([("s", 0, "cont", None, False), ("s", 1, "b", "2", True), ("s", 2, "cont b", None, False), ("s", 3, "a", "1", True)], "source string, line_no long, raw string, k string, start boolean")
    out = records.sorted_records(records.with_record(df, F.col("start"), 2), kinds.number(F.col("k")))
    assert [r["raw"] for r in out.collect()] == ["a", "b", "cont b", "cont"]


def test_rules_and_routes(spark):
    assert detect.glob_regex("*.log").startswith("(?i)")
    df = spark.createDataFrame([("s", "r", i * 1_000_000) for i in (0, 1, 2, 6, 20)], "source string, rule string, us long").withColumn("ts", F.timestamp_micros("us"))
    got = sorted((r["ts"].second, r["suppressed"]) for r in rules.limit_alerts(df, 5).collect())
    assert got == [(0, 0), (5, 2), (10, 1), (20, 0)]


def test_rules_and_top_values_take_whole_values(spark):
    from lograil.operators import rules, stats

    far = "x" * 70_000
    lines = spark.createDataFrame([("s", 0, far + " needle 42", far + "needle"), ("s", 1, far, far)], "source string, line_no long, raw string, path string")
    rs = [rules.Rule("lit", "needle", hide=True, tag="t"), rules.Rule("re", "[0-9]{2}", kind="regex", alert=True), rules.Rule("scope", "needle", scope="path", bookmark=True)]
    got = {r["line_no"]: (r["rules"], r["hidden"], r["alert"], r["bookmark"], r["tag"]) for r in rules.tag_lines(lines, rs, ("path",)).collect()}
    assert got == {0: (["lit", "re", "scope"], True, True, True, "t"), 1: ([], False, False, False, None)}

    head = "http://host/" + "p" * 300
    urls = [f"{head}/{i % 3}" for i in range(7)]
    d = spark.createDataFrame([(u,) for u in urls], "url string")
    top = [(r["value"], r["count"]) for r in stats.top_values(d, {"url": "text"}, 10).orderBy("nth").collect()]
    assert top == [(f"{head}/0", 3), (f"{head}/1", 2), (f"{head}/2", 2)]
    assert stats.profile(d, {"url": "text"}).first()["distinct_estimate"] == 3
