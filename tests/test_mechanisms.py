"""Operators that work in blocks, ranges and batches, against plain loops: encoded files, match sets, alerts, growing files, the merged view, detection, syslog by its RFCs."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograil.functions import times
from lograil.operators import detect, ingest, matchsets, records, rules
from lograil.sources import lines as sources
from lograil.streaming import live, merged


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be", "latin-1", "utf-8"])
@pytest.mark.parametrize("ending,end", [("\n", True), ("\r\n", False)])
def test_encoded_files_of_many_splits(spark, tmp_path, encoding, ending, end):
    rng = random.Random(7)
    letters = "ab é" + ("" if encoding == "latin-1" else "ĊĀ਀ഊഀਊ𐀊✓")
    want = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(700)] + ["last"]
    data = ending.join(want) + (ending if end else "")
    bom = "﻿" if encoding.startswith("utf-16") else ""
    (tmp_path / "a.log").write_bytes((bom + data).encode(encoding))
    (tmp_path / "b.log").write_bytes("x\ny".encode(encoding))
    name = {"latin-1": "ISO-8859-1", "utf-8": "UTF-8"}.get(encoding, encoding.upper().replace("-L", "L").replace("-B", "B"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1999")
    try:
        got = sources.read_encoded(spark, str(tmp_path), name, block_lines=64).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    of = lambda f: [r["raw"] for r in sorted((r for r in got if r["source"].endswith(f)), key=lambda r: r["line_no"])]
    assert of("a.log") == want and of("b.log") == ["x", "y"]
    assert sorted(r["line_no"] for r in got if r["source"].endswith("a.log")) == list(range(len(want)))


@pytest.mark.parametrize("encoding", ["UTF-16LE", "UTF-16BE", "UTF-32LE", "UTF-32BE"])
def test_wide_lines_are_put_together_where_they_are_read(spark, tmp_path, monkeypatch, encoding):
    """Lines of many pieces, batches and splits are written once, as lines; only those at the edges of splits are in parts."""
    want = ["", "Ċ਀ഊ" * 3000, "", *(f"Ċ਀ഊ{i}" for i in range(900)), "਀", "Ā" * 5000, "", "ഊਊ" * 40, "", ""]
    (tmp_path / "a.log").write_bytes("\n".join(want).encode(encoding.lower().replace("le", "-le").replace("be", "-be")))
    made = {}
    monkeypatch.setattr(sources, "materialize", lambda df, name, kept=sources.materialize: made.setdefault(name, kept(df, name)))
    options = {"spark.sql.files.maxPartitionBytes": "3001", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        got = sources.read_encoded(spark, str(tmp_path), encoding).orderBy("line_no").collect()
        splits, rows = made["splits"].count(), made["pieces"].count()
    finally:
        for k in options:
            spark.conf.unset(k)
    # As before, a separator at the very end begins no line.
    assert [(r["line_no"], r["raw"]) for r in got] == list(enumerate(want[:-1]))
    assert splits > 10 and rows <= len(want) + 2 * splits


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"])
def test_last_letters_with_the_byte_of_a_line_end(spark, tmp_path, encoding):
    texts = {"a": "x\nyĊ", "b": "x\ny਀", "c": "ऊ", "d": "x\n", "e": "x\n\n", "f": "x\nĊ\n", "g": "Ċ" * 2000, "h": "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode(encoding))
    got = defaultdict(list)
    for r in sources.read_encoded(spark, str(tmp_path), encoding.upper().replace("-L", "L").replace("-B", "B")).orderBy("line_no").collect():
        got[r["source"][-1]].append(r["raw"])
    assert got == {k: v.removesuffix("\n").split("\n") for k, v in texts.items()}


def test_encoded_files_that_end_at_cr(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("one\rtwo\r\rcrĊ".encode("utf-16-le"))
    assert [r["raw"] for r in sources.read_encoded(spark, str(tmp_path), "UTF-16LE", "cr").orderBy("line_no").collect()] == ["one", "two", "", "crĊ"]


def test_match_sets(spark):
    rng = np.random.default_rng(2)
    # Lines far apart, in many blocks; a source with one line; blocks that only one set has.
    sets = [{(f"s{i % 3}", int(x)) for i, x in enumerate(rng.integers(0, 200_000, 900))} | {("s0", 0), ("one", 32767), ("one", 32768)} for _ in range(2)]
    sets[0] |= {("s1", x) for x in range(32_760, 32_800)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "source string, line_no long")
    a, b = (matchsets.match_set(frame(s).union(frame(s))) for s in sets)
    every = sets[0] | sets[1] | {("s2", 7), ("none", 1)}
    lines = lambda m: {(r["source"], r["line_no"]) for r in matchsets.restricted(frame(every), m).collect()}
    assert lines(a) == sets[0]
    for op, want in (("and", sets[0] & sets[1]), ("or", sets[0] | sets[1]), ("minus", sets[0] - sets[1])):
        m = matchsets.combined(a, b, op)
        assert lines(m) == want, op
        n = defaultdict(int)
        for s, _ in want:
            n[s] += 1
        assert {r["source"]: r["n"] for r in matchsets.counts(m).collect()} == n
    assert {(r["source"], r["line_no"]) for r in matchsets.excluded(frame(every), a).collect()} == every - sets[0]
    asked = [(s, x) for s in ("s0", "s1", "one", "none") for x in (0, 1, 7, 8, 32766, 32767, 32768, 65535, 65536, 150_000, 10**9)]
    got = {(r["source"], r["line_no"]): (r["rank"], r["total"]) for r in matchsets.ranks(frame(asked), a).collect()}
    assert got == {(s, x): (sum(t == s and y <= x for t, y in sets[0]), sum(t == s for t, _ in sets[0])) for s, x in asked}


def test_match_sets_unpack_few_blocks_at_once(spark, monkeypatch):
    """However many blocks a batch has, bitmaps of few are held open."""

    def both(x, y, most=256):
        if len(x) > most:
            raise ValueError(f"{len(x)} blocks at once")
        return x & y

    monkeypatch.setitem(matchsets.OPERATIONS, "and", both)
    a, b = (matchsets.match_set(spark.range(0, 2500, step).selectExpr("concat('s', id) source", "id line_no").coalesce(1)).coalesce(1) for step in (1, 2))
    got = matchsets.restricted(spark.range(2500).selectExpr("concat('s', id) source", "id line_no"), matchsets.combined(a, b, "and"))
    assert sorted(r["line_no"] for r in got.collect()) == list(range(0, 2500, 2))


def plain_alerts(hits, span):
    """Hit by hit."""
    by, out = defaultdict(list), []
    for *key, at in hits:
        by[tuple(key)].append(at)
    for key, ats in by.items():
        last, held = None, 0
        for at in sorted(ats):
            while last is not None and held and at >= last + span:
                last, n, held = last + span, held, 0
                out.append((*key, last, n))
            if last is None or at >= last + span:
                out.append((*key, at, 0))
                last = at
            else:
                held += 1
        if held:
            out.append((*key, last + span, held))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_lines", [7, 100_000])
def test_alert_limit(spark, block_lines):
    rng, hits = random.Random(block_lines), []
    for k in range(6):
        at = -500
        for _ in range(300):
            at += rng.choice([0, 1, 3, 5, 9, 10, 11, 13, 15, 19, 20, 21, 30])
            hits.append((f"s{k % 3}", None if k == 5 else f"r{k}", at))
    hits += [("flood", "r", x) for x in range(0, 3000)] + [("once", "r", 5)] * 4
    d = spark.createDataFrame(hits + [("s0", "r0", None)], "source string, rule string, us long").withColumn("ts", F.timestamp_micros("us"))
    got = rules.limit_alerts(d, 1e-5, block_lines).withColumn("us", F.unix_micros("ts")).collect()
    assert sorted(((r["source"], r["rule"], r["us"], r["suppressed"]) for r in got), key=str) == plain_alerts(hits, 10)
    assert rules.limit_alerts(d.limit(0), 5).count() == 0


def test_alert_state_over_batches():
    rng = random.Random(3)
    ats = np.cumsum([rng.choice([0, 1, 4, 9, 10, 12, 19, 25]) for _ in range(500)])
    out, last, held = [], None, 0
    for part in np.array_split(ats, 23):
        told, last, held = rules.notifications(part, 10, last, held)
        out += [(t, n) for t, n, _ in told]
    out += [(last + 10, held)] * bool(held)
    assert sorted(out) == sorted((t, n) for _, t, n in plain_alerts([("s", int(x)) for x in ats], 10))


def drained(stream, path, spark, steps):
    """A stream's rows after each step has been taken and read."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime="100 milliseconds").start()
    try:
        for step in steps:
            step()
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{path}/out")


def test_growing_lines_equal_read_lines(spark, tmp_path):
    """Files of many ranges in several batches, long lines over ranges, growth in the middle of a line, and a query that starts again."""
    rng = random.Random(5)
    logs = tmp_path / "logs"
    logs.mkdir()
    text = lambda n: "".join("é" * rng.randrange(0, 60) + f" {i}" + rng.choice(["\n", "\r\n"]) for i in range(n))
    a = text(500) + "long " * 3000 + "\n" + text(200)
    b = text(300)
    cut = len(a) // 2

    def first():
        (logs / "a.log").write_text(a[:cut], newline="")
        (logs / "b.log").write_text(b, newline="")

    def second():
        with (logs / "a.log").open("a", newline="") as f:
            f.write(a[cut:])

    stream = lambda: live.growing_lines(spark, str(logs), str(tmp_path / "progress"), span=1500, batch=9000)
    drained(stream(), tmp_path, spark, [first])
    got = drained(stream(), tmp_path, spark, [second])
    assert got.select("source", "line_no").distinct().count() == got.count()
    want = sources.read_lines(spark, str(logs)).withColumn("source", F.regexp_replace("source", "^file:(//)?", ""))
    key = lambda df: sorted((r["source"], r["line_no"], r["byte_off"], r["raw"]) for r in df.select("source", "line_no", "byte_off", "raw").collect())
    assert key(got) == key(want)


def test_growing_ranges_and_generations(tmp_path):
    """The driver offers bytes, in batches of so many; another generation begins when a file is cut, rewritten or replaced."""
    f = tmp_path / "a.log"
    reader = live._Growing({"path": str(tmp_path), "span": "4", "batch": "10"})

    def read(start, end):
        out, base = [], defaultdict(int)
        for p in reader.partitions(start, end):
            for _, gen, lo, hi, n in reader.read(p):
                got = [x.decode() for _, x in live.lines_ending(p.path, lo, hi)]
                assert len(got) == n
                out += [(gen, x) for x in got]
        return out

    offsets = [reader.initialOffset()]

    def step():
        offsets.append(reader.latestOffset())
        return read(*offsets[-2:])

    f.write_text("one\ntwo\npart")
    assert step() == [(0, "one\n"), (0, "two\n")] and offsets[-1]["files"][str(f)][1] == 10
    assert step() == [] and offsets[-1]["files"][str(f)][1] == 12
    with f.open("a") as out:
        out.write("ial\n")
    assert step() == [(0, "partial\n")]
    f.write_text("one\ntwo\nPARTIAL\n")  # same length, other bytes
    assert step() + step() == [(1, "one\n"), (1, "two\n"), (1, "PARTIAL\n")]
    f.unlink()
    assert step() == []
    f.write_text("new\n")
    assert step() == [(2, "new\n")] and step() == []
    with pytest.raises(RuntimeError):  # another run that does not know what was read
        read(offsets[-1], live._Growing({"path": str(tmp_path)}).latestOffset())


def test_backlog_of_growing_files_takes_few_batches_and_tasks(tmp_path):
    """Batches double while more is waiting, up to the most, and are small again after it; many ranges make few tasks, and each range is given once."""
    f = tmp_path / "a.log"
    f.write_text("".join(f"line {i}\n" for i in range(20_000)))
    size = f.stat().st_size
    reader = live._Growing({"path": str(tmp_path), "span": "64", "batch": "256", "most": "65536"})
    offsets, ranges = [reader.initialOffset()], []
    while not ranges or ranges[-1][3] < size:
        offsets.append(reader.latestOffset())
        parts = reader.partitions(*offsets[-2:])
        assert len(parts) <= 2 * live.TASKS
        ranges += [r for p in parts for r in reader.read(p)]
    ends = [o["files"][str(f)][1] for o in offsets[1:]]
    taken = [b - a for a, b in zip([0, *ends], ends)]
    assert taken[:-1] == [min(256 << i, 65536) for i in range(len(taken) - 1)] and len(taken) < 14
    assert [r[2] for r in ranges] == [0, *[r[3] for r in ranges[:-1]]] and max(r[3] - r[2] for r in ranges) == 64 and sum(r[4] for r in ranges) == 20_000
    with f.open("a") as out:
        out.write("x" * 999)
    offsets.append(reader.latestOffset())
    assert offsets[-1]["files"][str(f)][1] == size + 256


def test_lines_longer_than_chunks(tmp_path, monkeypatch):
    want = ["a", "x" * 2500, "b", "", "y" * 1000, "c"]
    f = tmp_path / "a.log"
    f.write_text("\n".join(want) + "\nz")
    monkeypatch.setattr(live, "CHUNK", 1000)
    size = f.stat().st_size
    for span in (1, 7, 999, 1000, 5000):
        got = [(at, x) for lo in range(0, size, span) for at, x in live.lines_ending(str(f), lo, min(lo + span, size))]
        assert [x.decode()[:-1] for _, x in got] == want and [at for at, _ in got] == [0, 2, 2503, 2505, 2506, 3507]
        assert sum(live.line_ends(str(f), lo, min(lo + span, size)) for lo in range(0, size, span)) == len(want)


def test_merged_view_is_the_ranked_order(spark, tmp_path):
    """Batch by batch: what is given out is final, and all of it together is the order of all lines; a repeated batch changes nothing."""
    rng = random.Random(1)
    rows = []
    for s in range(4):
        t = None
        for i in range(120):
            if rng.random() < 0.8:
                t = max(t or 0, (t or 1000 * s) + rng.randrange(-50, 100))
            rows.append((f"s{s}", i, f"line {i}", t if i > 2 else None))
    cols = "source string, line_no long, raw string, eff_us long"
    frame = spark.createDataFrame(rows, cols)
    view = merged.MergedView(str(tmp_path / "view"), idle_ms=1 << 40)
    for k, (lo, hi) in enumerate(((0, 2), (2, 50), (50, 51), (51, 120))):
        batch = frame.filter(F.col("line_no").between(lo, hi - 1))
        view(batch, k)
        if k == 2:
            view(batch, k)
        if k == 0:
            assert view.rows(spark).count() == 0  # no source has a time yet
    early = view.rows(spark).count()
    view.finish(spark)
    got = [(r["source"], r["line_no"], r["eff_us"], r["nth"]) for r in view.rows(spark).orderBy("nth").collect()]
    want = [(r["source"], r["line_no"], r["eff_us"], r["nth"]) for r in records.ranked(frame, F.col("eff_us").asc_nulls_first(), F.col("source"), F.col("line_no")).orderBy("nth").collect()]
    assert got == want and 0 < early < len(rows) and view.rows(spark).filter("late").count() == 0


def test_merged_view_marks_late_lines(spark, tmp_path):
    cols = "merge string, source string, line_no long, raw string, eff_us long"
    view = merged.MergedView(str(tmp_path / "view"), idle_ms=0)  # every source is idle at once
    view(spark.createDataFrame([("g", "a", 0, "x", 10), ("g", "a", 1, "y", 20), ("h", "c", 0, "z", 5)], cols), 0)
    view(spark.createDataFrame([("g", "b", 0, "w", 15), ("g", "a", 2, "v", 30)], cols), 1)
    got = sorted((r["merge"], r["nth"], r["source"], r["line_no"], r["late"]) for r in view.rows(spark).collect())
    assert got == [("g", 1, "a", 0, False), ("g", 2, "a", 1, False), ("g", 3, "b", 0, True), ("g", 4, "a", 2, False), ("h", 1, "c", 0, False)]


def test_syslog_follows_its_rfcs(spark):
    raws = [
        '<165>123 2003-10-11T22:14:15.003Z mymachine.example.com evntslog - ID47 [exampleSDID@32473 iut="3" eventSource="App\\]\\"x"][other@1] ﻿An event', "<34>1 2003-10-11T22:14:15Z host su - ID47 - 'su root' failed", "<34>1 - - - - - -",
        '<34>1 2003-10-11T22:14:15Z host app - - [a b="x]"] text', '<34>1 2003-10-11T22:14:15Z host app - - [a b=x] text', "<34>0 - - - - - -", "<34>1 2003-10-11 22:14:15 host app - - - text", '<34>1 - - - - - [a b="x"][a b="y" c=""]',
    ]
    out = ingest.syslog_5424(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")).withColumn("params", ingest.structured_data(F.col("sd"))).orderBy("i").collect()
    assert [r["is_record"] for r in out] == [True, True, True, False, False, False, False, True]
    assert out[0]["version"] == "123" and out[0]["params"] == {"exampleSDID@32473.iut": "3", "exampleSDID@32473.eventSource": 'App]"x'} and out[0]["msg"].endswith("An event")
    assert out[1]["msg"] == "'su root' failed" and out[1]["params"] is None and out[7]["params"] == {"a.b": "x", "a.c": ""}
    raws = ["<34>Oct 11 22:14:15 mymachine su: 'su root' failed", "Oct  1 02:04:05 host systemd-logind[12]: New", "Oct 1 02:04:05 host x: y", "Feb  5 17:32:18 10.0.0.99 Use the BFG!", "Feb 05 17:32:18 host cron[x]: y", "<13>Feb  5 17:32:18 host app"]
    got = [(r["is_record"], r["pri"], r["host"], r["tag"], r["pid"], r["msg"]) for r in ingest.syslog_3164(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")).orderBy("i").collect()]
    no = (False, None, None, None, None, None)
    assert got == [(True, "34", "mymachine", "su", None, "'su root' failed"), (True, None, "host", "systemd-logind", "12", "New"), no, (True, None, "10.0.0.99", "Use", None, "the BFG!"), no, (True, "13", "host", "app", None, None)]


def test_line_parts(spark):
    cases = {
        "2024-01-02 03:04:05,123 ERROR [main] app.Svc - boom": ("iso", "TLBG"), "[2024/01/02 03:04:05] warn: low": ("slashed", "TL"), "INFO 2024-01-02T03:04:05Z started": ("iso", "LT"), "Jan  2 03:04:05 host su: x": ("syslog", "T"),
        "1/2/2024, 3:04:05 PM [t-1] DEBUG a.b.C: x": ("us", "TBLG"), "31.12.2024 23:59:59 - INFO - x": ("day_first", "TL"), "03:04:05.678 TRACE": ("clock", "TL"), "1704164645123 E x": ("epoch", "T"),
    }
    got = spark.createDataFrame([(k,) for k in [*cases, "no time here", "", "x 2024-01-02 y z w"]], "raw string").select("raw", detect.line_parts(F.col("raw")).alias("p")).collect()
    for r in got:
        if r["raw"] in cases:
            family, code = cases[r["raw"]]
            assert r["p"]["family"] == family and r["p"]["code"].startswith(code), r
        else:
            assert r["p"] is None, r


def test_first_timestamp_of_a_line(spark):
    cases = {
        "at 10:11:12 or 2024-01-02 03:04:05 it was": "iso", "[02/Jan/2024:03:04:05 +0000] 2024-01-02 03:04:05": "apache", "2024-01-02 03:04:05,5 x": "iso_comma", "ts=1704164645 x": "epoch_s", "(1704164645123) 10:11:12": "epoch_ms", "took 1704164645": None,
        "é" * 250 + " 2024-01-02 03:04:05": None, "e" * 250 + " 2024-01-02 03:04:05": "iso", "Tue, 2 Jan 2024 03:04:05 +0000": "rfc2822", "20240102T030405Z": "compact", "v12:13:14": None,
    }
    got = {r["raw"]: r["f"] for r in spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", times.line_format(F.col("raw")).alias("f")).collect()}
    assert got == cases
    plan = spark.range(1).select(times.line_instant(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 4 and "regexp_instr" not in plan


def test_logfmt_escapes_in_one_pass(spark):
    raws = ['a="x\u0001y" b="\\\\n" c="\\n\\t\\\\" d="q\\"q" e="open \\', 'f="" g="\\é\\"']
    got = [r["m"] for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(ingest.logfmt_pairs(F.col("raw")).alias("m")).collect()]
    assert got[0] == {"a": "x\u0001y", "b": "\\n", "c": "\n\t\\", "d": 'q"q', "e": "open \\"} and got[1]["f"] == ""


def test_headed_cells(spark):
    rows = [("a", 0, 'x;"y;z";x;'), ("a", 1, '1;"2;""3""";4;5'), ("a", 2, "1;2"), ("a", 3, '"1;2;3;4'), ("a", 4, ";;;"), ("b", 0, "k"), ("b", 1, "v"), ("b", 2, ""), ("c", 1, "no head")]
    got = {(r["source"], r["line_no"]): r["fields"] for r in ingest.headed(spark.createDataFrame(rows, "source string, line_no long, raw string"), ";").collect()}
    assert got == {("a", 0): None, ("a", 1): {"x": "1", "y;z": '2;"3"', "col4": "5"}, ("a", 2): None, ("a", 3): None, ("a", 4): {}, ("b", 0): None, ("b", 1): {"k": "v"}, ("b", 2): None, ("c", 1): None}


def test_frequent_values_are_exact(spark, monkeypatch):
    """Skewed, flat and small columns, states of few counters, parts that merge in any order."""
    from collections import Counter

    from lograil.operators import stats

    rng = random.Random(4)
    rows = [(f"v{int(rng.paretovariate(0.8))}", f"f{rng.randrange(900)}", rng.choice(["x", "y", "", None]), rng.choice(["warn", "W", "error"])) for _ in range(6000)]
    d = spark.createDataFrame(rows, "skewed string, flat string, small string, level string").repartition(5)
    kinds_of = {"skewed": "text", "flat": "text", "small": "text", "level": "level"}
    key = lambda df: sorted((r["name"], r["nth"], r["value"], r["count"]) for r in df.collect())
    assert key(stats.frequent_values(d, kinds_of, 5, counters=40)) == key(stats.top_values(d, kinds_of, 5))
    parts = [stats.frequent_state(d.filter(F.col("flat").substr(-1, 1).isin(*x)), kinds_of, 40) for x in (["1", "2"], ["3"], ["0", "4", "5", "6", "7", "8", "9"])]
    state = stats.merged_frequent(stats.merged_frequent(parts[0].union(parts[1]), 40).union(parts[2]), 40).collect()
    error = {r["name"]: r["count"] for r in state if r["value"] is None}
    assert error["small"] == error["level"] == 0 < error["flat"] and max(Counter(r["name"] for r in state).values()) <= 41
    for i, name in enumerate(("skewed", "flat")):
        true = Counter(r[i] for r in rows)
        held = {r["value"]: r["count"] for r in state if r["name"] == name and r["value"] is not None}
        assert all(held.get(v, 0) <= n <= held.get(v, 0) + error[name] for v, n in true.items())


def test_views_count_a_repeated_batch_once(spark, tmp_path):
    from lograil.operators import stats
    from lograil.streaming import views

    rows = [(f"s{i % 3}", i, str(i % 7) if i % 5 else None) for i in range(300)]
    d = spark.createDataFrame(rows, "source string, line_no long, n string")
    view = views.ProfileView(str(tmp_path / "p"), {"n": "number", "source": "text"})
    for k, (lo, hi) in enumerate(((0, 100), (100, 150), (150, 300))):
        batch = d.filter(F.col("line_no").between(lo, hi - 1))
        view(batch, k)
        if k == 1:
            view(batch, k)
    cols = ["name", "count", "missing", "numeric_count", "min", "max", "distinct_estimate", "p50"]
    assert view.profile(spark).select(cols).orderBy("name").collect() == stats.profile(d, {"n": "number", "source": "text"}).select(cols).orderBy("name").collect()
    got = {(r["name"], r["value"]): (r["at_least"], r["at_most"]) for r in view.frequent(spark, 3).collect()}
    assert got[("source", "s0")] == (100, 100) and all(a == b for a, b in got.values())

    path = str(tmp_path / "b")
    views.add_manual(d.filter("line_no in (1, 2)"), path)
    for name in ("one", "two"):
        view = views.BookmarkView(path, name)
        for k in (0, 1, 1):
            view(d.filter(F.col("line_no").between(k, k + 3)), k)
    got = sorted((r["line_no"], r["automatic"]) for r in views.bookmarks(spark, path).collect())
    assert got == [(0, True), (1, False), (2, False), (3, True), (4, True)]


def test_shared_folder_is_cleared(spark):
    import os

    from lograil import shared
    from lograil.plans import catalog

    catalog.queries()["q_read_lines"](spark, "/root/testdata/sf0.001").count()
    folder = shared.shared_dir(spark).removeprefix("file://") + "/lograil"
    made = [p.rsplit("/", 1)[1] for p in shared._made]
    assert made and any(name in os.listdir(folder) for name in made)
    shared.clear(spark)
    assert not set(made) & set(os.listdir(folder)) and not shared._made


@pytest.mark.parametrize("before,after", [(0, 0), (2, 1), (0, 5), (7, 0), (30, 40)])
def test_context_in_order(spark, before, after):
    """Lines in order over partitions and batches, lines out of order, runs of one line; all against the join by number."""
    from lograil.operators import context

    rng = random.Random(before)
    rows = [(f"s{k}", i, "hit" if rng.random() < 0.03 else "line") for k in range(4) for i in range(rng.choice([1, 50, 700]))]
    ordered = spark.createDataFrame(rows, "source string, line_no long, raw string")
    mixed = spark.createDataFrame(rng.sample(rows, len(rows)), ordered.schema)
    key = lambda df: sorted(map(tuple, df.select("source", "line_no", "raw", "is_context").collect()))
    want = key(records.with_context(ordered, F.col("raw") == "hit", before, after))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        for d in (ordered.coalesce(1), ordered, mixed, ordered.filter("line_no % 10 <> 3")):
            expected = want if d.count() == len(rows) else key(records.with_context(d, F.col("raw") == "hit", before, after))
            assert key(context.context_in_order(d, F.col("raw") == "hit", before, after)) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert context.context_in_order(ordered.limit(0), F.col("raw") == "hit", before, after).count() == 0


def test_exact_percentiles_with_ties_and_bad_bounds(spark, monkeypatch):
    """Nearest rank by brute force: many ties, few values, signs, one value, none; also where the bounds miss the percentiles."""
    from lograil.operators import stats

    rows = [(float(i % 7), float((i * 7919) % 3001 - 1500), 5.0 if i else None, None, i % 3 == 0) for i in range(3000)]
    d = spark.createDataFrame(rows, "a double, b double, c double, e double, is_record boolean").repartition(5)
    columns = dict.fromkeys("abce", "number")

    def nearest(values, p):
        values = sorted(v for v in values if v is not None)
        return values[max(math.ceil(p * len(values)), 1) - 1] if values else None

    want = {c: tuple(nearest([r[i] for r in rows if r[4]], p) for p in (0.5, 0.9, 0.99)) for i, c in enumerate("abce")}
    for bounds in (stats._BOUNDS, [0.1, 0.2] * 3):
        monkeypatch.setattr(stats, "_BOUNDS", bounds)
        got = {r["name"]: r for r in stats.profile(d, columns, exact=True).collect()}
        assert {c: (got[c]["p50"], got[c]["p90"], got[c]["p99"]) for c in "abce"} == want
        assert {c: (r["records"], r["skipped"], r["count"]) for c, r in got.items()} == {"a": (1000, 2000, 1000), "b": (1000, 2000, 1000), "c": (1000, 2000, 999), "e": (1000, 2000, 0)}
    state = stats.profile_of(stats.merged_states(stats.profile_state(d.filter("a < 3"), columns).unionByName(stats.profile_state(d.filter("a >= 3"), columns))))
    assert {(r["name"], r["records"], r["skipped"]) for r in state.collect()} == {(c, 1000, 2000) for c in "abce"}
    assert stats.profile(d.filter("a > 9"), columns, exact=True).filter("p50 is null and count = 0").count() == 4


def test_detection_counts_lines_that_look_alike(spark):
    """Lines are counted by how they look to the formats before candidates are told apart, and digits make no difference to text lines."""
    lines = spark.range(5000).selectExpr("concat('a', id % 1) source", "id line_no", "concat('2024-01-02 03:04:', lpad(id % 60, 2, '0'), ' INFO event ', id) raw")
    out = detect.detect_formats(lines, 1 << 40)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    alike = next(x for x in plan[plan.index("explode(") :].splitlines() if "Aggregate [" in x)
    assert "_stamped" in alike
    heads = lines.select(detect._stamped(detect._marked(F.col("raw"))).alias("x")).distinct().collect()
    assert sorted(r["x"] for r in heads) == [f"iso \u0001T INFO event {'0' * n}" for n in (1, 2, 3, 4)]
    assert [(r["format"], r["score"]) for r in out.filter("nth = 1").collect()] == [("time_level_message:iso", 0.95)]


def test_lines_are_read_by_their_looks(spark, monkeypatch):
    """Whatever is in a line, its look has the parts, the separators and the cells that it has, and lines whose heads differ in digits only have one look."""
    rng = random.Random(3)
    times_of = ["2024-01-02 03:04:05,678", "2024/01/02 03:04:05", "20240102T030405Z", "02/Jan/2024:03:04:05 +0000", "Tue, 2 Jan 2024 03:04:05 +0000", "1/2/2024, 3:04:05 PM", "Jan  2 03:04:05", "03:04:05.678", "1704164645123", "02.01.2024 03:04:05", "٣٤:04:05", "9/9"]
    words = ["INFO", "[w-17]", "app.Svc:", "-", "--", "", "a,b", '"x, ""y|z"', '"', "p|q", "c;d", "\t", "é9", "٣", "\x01", "\x1e", "😀", "x" * 300, "7" * 260, "[]", "(ERROR)"]
    rows = ["".join([rng.choice(["", "", "[", "(", "WARN ", "[ERROR]\t", "info: ", "x\x01", "9 "]), rng.choice([*times_of, ""]), *(rng.choice([" ", " ", "\t", ",", "]"]) + rng.choice(words) for _ in range(rng.randrange(7)))]) for _ in range(4000)]
    d = spark.createDataFrame([(r,) for r in rows if r.strip(" ")], "raw string").withColumn("look", detect._look(F.col("raw")))

    def seen(c):
        quoted = F.regexp_replace(c, '"(?:[^"]|"")*"', "q")
        cells = F.when(F.contains(c, F.lit("\t")), F.split(c, "\t")).otherwise(F.split(c, " "))
        return [detect.line_parts(c), F.transform(cells, lambda x: x.isin("", "-")), *[F.regexp_replace(quoted, f"[^{sep[-1]}]+", "1") for sep in detect.DELIMITED.values()]]

    d = d.select("raw", F.struct(*seen(F.col("raw"))).alias("a"), F.struct(*seen(F.col("look"))).alias("b"))
    got = d.collect()
    assert [r["raw"] for r in got if r["a"] != r["b"]] == [] and sum(r["a"][0] is not None for r in got) > 1000
    made, kept = [], detect.materialize
    monkeypatch.setattr(detect, "materialize", lambda df, name: made.append(kept(df, name)) or made[-1])
    head = "concat(lpad(id % 24, 2, '0'), ':', lpad(id % 60, 2, '0'), ':07 INFO event ', 1000 + id)"
    lines = spark.range(3000).selectExpr("'a' source", "id line_no", f"if(id = 5, '#Fields: a b c', if(id = 7, '#Fields: a', {head})) raw")
    got = {(r["format"], r["score"]) for r in detect.detect_formats(lines, 1 << 40).collect()}
    assert got == {("time_level_message:clock", 0.95), ("time_message:clock", 0.6)} and [m.count() for m in made] == [3]


def test_keys_are_found_without_a_sort_of_all(spark):
    lines = spark.createDataFrame([("a", 3, "x=1 ts=2"), ("a", 1, "y=1 b=2 msg=z"), ("a", 2, "b=2 c=1"), ("a", 1 << 62, "x=1 w=1")], "source string, line_no long, raw string")
    out = ingest.discover_columns(lines, ingest.logfmt_pairs(F.col("raw")), sample=(1 << 62) + 1)
    assert "SortAggregate" not in out._jdf.queryExecution().sparkPlan().toString()
    assert [r["name"] for r in out.orderBy("nth").collect()] == ["ts", "y", "b", "c", "x", "w", "msg"]


def test_frequent_values_read_records_twice_at_most(spark):
    """Once for the states, and once more for columns whose states are not exact."""
    from lograil.operators import stats

    rng = random.Random(5)
    rows = [(f"v{int(rng.paretovariate(0.8))}", rng.choice("xyz")) for _ in range(4000)]
    made, read = spark.createDataFrame(rows, "skewed string, small string").repartition(3), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    d, key = made.mapInArrow(seen, made.schema), lambda df: sorted((r["name"], r["nth"], r["value"], r["count"]) for r in df.collect())
    for columns, times_read in ((["small"], 1), (["skewed", "small"], 2)):
        kinds_of = dict.fromkeys(columns, "text")
        want = key(stats.top_values(made, kinds_of, 3))
        before = read.value
        assert key(stats.frequent_values(d, kinds_of, 3, counters=40)) == want
        assert read.value - before == times_read * len(rows)
