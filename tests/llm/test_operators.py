"""Each operator on a small table of hard cases, against brute force: nulls, empty and repeated texts, ties, clashing extra columns, empty tables."""

import hashlib
import math
import re
import zlib
from math import comb, lgamma

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograil.llm import fingerprints, langid, line_dedup, mixing, near_dedup, packing, quality, suffix_dedup, toxicity, warc

LINE = "a line that is long enough to count as repeated text here"
BODY = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "short", BODY, BODY, BODY + " tail", BODY.replace("word30", "other"), f"{LINE}\nown text one", f"own\n {LINE.upper()} \nmore", f"{LINE}\n{LINE}", f"x\n{LINE}", f"{LINE}", "ä" * 300, "word " * 400,
    "Zürich ist schön und groß " * 30, LINE + BODY[:150] + "middle" + BODY[:150], "\x00 odd   space",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, part int, kept boolean, runs string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), 7, 1, None, "x", 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i in (4, 8))) for i in range(len(TEXTS))] + [(3, None, None)], "doc_id long, quality int, toxic int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_fingerprints(docs, none):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(range(len(TEXTS)), reverse=True)
    for k, i in enumerate(order):
        t, nxt = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[4]["fingerprint"] == got[5]["fingerprint"] != got[6]["fingerprint"]
    assert got[5]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(none).count() == 0


def brute_sketch(spark, texts, size=5, k=fingerprints.FINGERPRINT_K):
    """Sketches by a plain loop; only the hash of one shingle is Spark's."""
    lists = []
    for t in texts:
        w = words(t)
        lists.append([w[i : i + size] for i in range(len(w) - size + 1)] if len(w) >= size else [w] if w else [])
    kinds = sorted({tuple(x) for xs in lists for x in xs})
    rows = spark.createDataFrame([(list(x),) for x in kinds], "w array<string>").withColumn("h", F.xxhash64("w")).collect() if kinds else []
    h = {tuple(r["w"]): (r["h"] % 2**64) >> 16 for r in rows}
    return [sorted({h[tuple(x)] for x in xs})[:k] for xs in lists], [{h[tuple(x)] for x in xs} for xs in lists]


def test_fingerprints_by_brute_force(spark):
    r = np.random.default_rng(5)
    base = [f"w{int(i)}" for i in r.integers(0, 4000, 900)]
    texts = [" ".join(base), " ".join(base[:700] + [f"x{i}" for i in range(200)]), " ".join(base[300:600]), "", "one two", " ".join(base * 3)]
    ids = [(1 << 62), 5, -(1 << 63), 5, None, (1 << 63) - 1]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    out = fingerprints.edited_fingerprints(docs).collect()
    sketches, full = brute_sketch(spark, texts)
    text = lambda s: "".join(f"{x:012x}" for x in s)
    assert sorted(x["fingerprint"] for x in out) == sorted(map(text, sketches)) and len({x["edited_sha256"] for x in out}) == len(out)
    by = {text(s): (i, s) for i, s in enumerate(sketches)}
    order = sorted(out, key=lambda x: (x["doc_id"] is None, -(x["doc_id"] or 0)))
    for x, y in zip(order, order[1:] + order[:1]):
        a, b = by[x["fingerprint"]][1], by[y["fingerprint"]][1]
        if order.index(x) in (0, 3, 4, 5):  # the two rows of id 5 are in a free order
            both = sorted(set(a) | set(b))[:128]
            assert x["near_next"] == pytest.approx(len(set(a) & set(b) & set(both)) / len(both) if both else 1.0)
    # Estimates against whole sets.
    d = fingerprints.fingerprints(docs.filter("doc_id is not null and text <> ''").withColumn("sketch", F.lit("clash"))).select("text", "sketch", "n_distinct")
    x, y = d.select(F.col("text").alias("ta"), F.col("sketch").alias("a"), "n_distinct"), d.select(F.col("text").alias("tb"), F.col("sketch").alias("b"))
    for row in x.join(y).select("ta", "tb", "n_distinct", fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c")).collect():
        a, b = full[texts.index(row["ta"])], full[texts.index(row["tb"])]
        assert abs(row["r"] - len(a & b) / len(a | b)) < 0.16 and abs(row["c"] - len(a & b) / len(a)) < 0.3 and abs(row["n_distinct"] - len(a)) < 0.3 * len(a)
    # Sketches of parts merge to that of all their shingles.
    parts = fingerprints.fingerprints(docs).withColumn("g", F.lit(1))
    got = fingerprints.merged_sketches(parts, ["g"]).first()
    assert got["sketch"] == sorted(set().union(*full))[:128]


def test_next_documents_over_many_buckets(spark, monkeypatch):
    """Uneven ids, repeated rows and buckets of two rows."""
    monkeypatch.setattr(fingerprints, "MIN_WIDTH", 2)
    monkeypatch.setattr(fingerprints, "GROUP", 3)
    ids = [*range(40), *(10**15 + k * 7 for k in range(20)), *[5] * 9]
    rows = [(i, f"text {i}") for i in ids]
    got = sorted((r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    order = sorted(rows, reverse=True)
    assert got == sorted((i, t, n) for (i, t), (_, n) in zip(order, order[1:] + order[:1]))


def test_near_groups(docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(docs, 4, 80).collect()}
    sets = []
    for t in TEXTS:
        w = words(t)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()})
    parent = list(range(len(TEXTS)))
    for _ in parent:
        for i in range(len(sets)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert got == {i: (len(sets[i]), parent[i], parent[i] == i) for i in range(len(TEXTS))}
    assert near_dedup.near_groups(none, 4, 80).count() == 0


def test_near_groups_of_a_star(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))] + [(k, " ".join([*base[:k], f"n{k}", *base[k + 1 :]])) for k in range(1, 90)] + [(100 + k, " ".join(f"z{k}q{i}" for i in range(50))) for k in range(20)]
    out = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).filter("doc_id < 100").select("component_id").distinct().collect()
    assert [r[0] for r in out] == [0]


def test_near_groups_in_blocks(spark, monkeypatch):
    """Components of many blocks: near copies of one text, sets that only share half with them, and links among these; against all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 700)
    monkeypatch.setattr(near_dedup, "SLACK", 0.8)  # all that shares a region is linked provisionally
    r = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(70):
        ws = list(base)
        for x in r.integers(0, 120, 2 if k % 3 else 30):
            ws[int(x)] = f"n{k % 3 == 0 and k // 9}q{x}"
        rows.append((k, " ".join(ws)))
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    least = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == dict(enumerate(least)) and len(set(least)) > 3


def test_near_groups_find_what_all_pairs_find(spark):
    """Every fourth text against all rows, by brute force: no link is lost, and none is made up."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    group = {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(docs, 5, 80).collect()}
    sets = {}
    for x in docs.collect():
        w = words(x["text"])
        sets[x["doc_id"]] = {hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)} if len(w) >= 5 else {hash(tuple(w))} if w else set()
    links = lost = 0
    for q in (i for i in sets if i % 4 == 0):
        for i, s in sets.items():
            if i != q and s and sets[q] and 100 * len(s & sets[q]) >= 80 * len(s | sets[q]):
                links += 1
                lost += group[i] != group[q]
    assert links > 20 and lost == 0


def brute_suffix(rows, n=100):
    seen, out = set(), {}
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            gone.update(range(p, p + n)) if s in seen else seen.add(s)
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out[i] = (len(b), len(gone), sum(1 for x in gone if x - 1 not in gone), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, none):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_suffix(enumerate(TEXTS))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_null_ids_and_random_texts(spark):
    r = np.random.default_rng(1)
    parts = ["".join(r.choice(list("ab "), 130)) for _ in range(6)]
    rows = [(i, "".join(parts[k] for k in r.integers(0, 6, 4)) + "".join(r.choice(list("ab"), 40))) for i in range(60)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(spark.createDataFrame([*rows, (None, BODY), (None, BODY)], "doc_id long, text string")).collect()}
    assert got.pop(None)[1] == 0
    assert got == brute_suffix(rows)


def test_packing(docs, none):
    from lograil.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    out = packing.pack(packing.token_pieces(docs, tokenizer_path())).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(p, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == i) == want
    check_places(out, 2048)
    assert packing.pack(packing.token_pieces(none, tokenizer_path())).count() == 0


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_many_lengths(spark):
    r = np.random.default_rng(2)
    n = [int(x) for x in np.minimum(2048, r.lognormal(6, 1, 3000).astype(int) + 1)]
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(n)], "doc_id long, piece int, length long")
    out = packing.pack(rows).collect()
    assert len(out) == len(n) and check_places(out, 2048) <= 1.02 * -(-sum(n) // 2048) + 1


def test_warc_round_trip(spark, tmp_path):
    pages = [(0, "http://a/\r\nX: y", "<p>one</p>"), (1, "http://b", "WARC/1.1\r\n\r\nfake\r\n\r\n"), (2, "http://c", "<p>one</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "ü" * 3000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record string")
    want = {0: ("revisit", 2, 10), 1: ("response", None, 20), 2: ("response", None, 10), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 6000)}
    for name, compress in (("members", True), ("plain", False)):
        path = warc.write_archives(df, f"file://{tmp_path}/{name}", compress=compress)
        got = {r["page_id"]: r for r in warc.resolved(warc.read_archives(spark, path)).collect()}
        assert {i: (r["record_type"], r["refers_to"], r["payload_bytes"]) for i, r in got.items()} == want
        assert got[4]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert warc.resolved(warc.read_archives(spark, warc.write_archives(df, f"file://{tmp_path}/big", min_bytes=10))).filter("record_type = 'revisit'").count() == 1
    # Null and repeated ids and rows, and no rows at all.
    odd = spark.createDataFrame([(7, "u", "same"), (7, "u", "same"), (3, "u", "same"), (None, "u", "same"), (None, None, "alone")], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.resolved(warc.read_archives(spark, warc.write_archives(odd, f"file://{tmp_path}/odd"))).collect()), key=str)
    assert got == sorted([(7, "response", None)] * 2 + [(3, "revisit", 7), (None, "revisit", 7), (None, "response", None)], key=str)
    assert warc.resolved(warc.read_archives(spark, warc.write_archives(odd.limit(0), f"file://{tmp_path}/none"))).count() == 0


def test_warc_files_of_others(spark, tmp_path):
    """One member for all records, one for each, and no compression; records of other types, and a payload with its own line breaks."""
    import gzip

    record = lambda kind, i, block, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    http = "Content-Type: application/http; msgtype=response\r\n"
    big = bytes(range(256)) * 2000
    parts = [record("warcinfo", 0, b"software: x"), record("request", 1, b"GET / HTTP/1.1\r\n\r\n", http), record("response", 2, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + big, http), record("resource", 3, b"WARC/1.0\r\n\r\n"), record("response", 4, b"HTTP/1.1 204\r\n\r\n", http)]
    for name, data in (("one", gzip.compress(b"".join(parts))), ("each", b"".join(map(gzip.compress, parts))), ("plain", b"".join(parts))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        got = {r["record_id"]: (r["record_type"], r["payload_bytes"]) for r in warc.read_archives(spark, f"file://{tmp_path}/{name}").collect()}
        assert got == {"<urn:uuid:2>": ("response", len(big)), "<urn:uuid:3>": ("resource", 12), "<urn:uuid:4>": ("response", 0)}, name


def test_mixing(docs, none):
    out = mixing.mix(docs).collect()
    size = {i: len(words(t)) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["size"] for r in out} == size
    by = {}
    for r in out:
        assert r["taken"] in (r["size"] * k for k in range(4))
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - sum(size.values())) < 1e-6
    for rs in by.values():
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
    assert mixing.mix(none).count() == 0


def test_quality(docs, labels, none):
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {k + o for k, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(twice), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(none, labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.1), (2, 500, 0.01), (40, 1000, 0.05), (0, 300, 0.05), (20_000, 500_000, 0.042)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        log = lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
        assert got == pytest.approx(1.0 if k >= n * p else math.fsum(math.exp(log(i)) for i in range(k + 1)), rel=1e-6)


def test_quality_cutoffs_act(spark):
    """Planted labels: one stratum with enough good documents, whose cutoffs are those of a plain loop over the chain, and one with too few."""
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows, labels = [], []
    for i in range(700):
        ws = [word() for _ in range(60)]
        for k in range(int(r.integers(0, 2)) if i % 10 else int(r.integers(5, 50))):
            ws[k] += "###"
        rows.append((i, " ".join(ws), "few" if i % 20 == 1 else "many"))
        if i % 10 or i % 30 == 0:
            labels.append((i, 1 if i % 10 else int(i % 60 == 0)))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, *labels[:5], (None, 1), (3, None)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.judge(docs, given).collect()}
    good = {i for i, y in labels if y == 1}
    shares = {i: t.count("#") / len(t.replace(" ", "")) for i, t, _ in rows}
    tail = lambda k, n: sum(comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(k + 1))
    for lang in ("many", "few"):
        mine = [i for i, _, x in rows if x == lang]
        held = [shares[i] for i in mine if i in good]
        cut = None
        for c in sorted(quality.RULES["symbol_share"], reverse=True):  # only this rule rejects anything
            if tail(sum(v > c for v in held), len(held)) > 0.05 / 2:
                break
            cut = c
        assert {i: got[i]["kept"] for i in mine} == {i: cut is None or shares[i] <= cut for i in mine}
        assert (cut is None) == (lang == "few")
    assert any(not x["kept"] for x in got.values()) and quality.cutoffs(6) == {"symbol_share": 0.3, "dup_line_share": 0.7, "repeat_share": 0.5, "upper_share": 0.9, "mean_word_chars": 50.0}


def test_line_dedup(docs, none):
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    keys = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    holders = {}
    for i, t in enumerate(TEXTS):
        for k in keys(t):
            holders.setdefault(k, set()).add(i)
    for i, t in enumerate(TEXTS):
        keep = [x for x, k in zip((t or "").split("\n"), keys(t)) if not (len(k) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != i)]
        assert out[i]["kept_text"] == "\n".join(keep) and out[i]["n_lines"] == len(keys(t)) and out[i]["n_dropped"] == len(keys(t)) - len(keep)
    assert line_dedup.dedup_lines(none).count() == 0


def test_repeated_ids(spark, none):
    """Rows of one id are rows of their own: equal texts, different texts, and copies of other ids."""
    import corpus_pipeline

    own = [" ".join(f"own{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [(1, BODY), (7, BODY), (7, own[0]), (7, own[1]), (7, own[1]), (8, own[2]), (8, own[2] + " tail"), (9, own[0])]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(docs).collect())
    assert near == [(1, 1, True), (7, 1, False), (7, 7, False), (7, 7, True), (7, 7, True), (8, 8, False), (8, 8, True), (9, 7, False)]
    left = [(r["doc_id"], r["text"].removesuffix(" tail")) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(left) == sorted([(1, BODY), (7, own[0]), (7, own[1]), (8, own[2])])

    # The order of an id's rows is free; all orders give the same bytes here.
    got = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeats(docs.filter("doc_id <> 8")).collect())
    assert got == sorted([(1, BODY), (7, ""), (7, own[0]), (7, ""), (7, own[1]), (9, "")])

    lines = [(k, f"{LINE}\nline {k}") for k in range(5)] + [(4, f"{LINE}\nline 4"), (3, f"other {LINE}\nmore"), (3, f"head\n{LINE}"), (3, f"head\n{LINE}")]
    out = sorted((r["doc_id"], r["kept_text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(lines, "doc_id long, text string")).collect())
    assert out == sorted([(k, f"line {k}") for k in range(4)] + [(4, f"{LINE}\nline 4")] * 2 + [(3, f"other {LINE}\nmore"), (3, "head"), (3, "head")])


def test_toxicity(docs, labels, none):
    net = toxicity.GatedNet().learn([f"{BODY[:80]} idiot clown {i}" if i % 2 else f"{BODY[80:200]} {i}" for i in range(60)], np.arange(60) % 2, steps=40)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
    assert len(out) == len(TEXTS) and all(0 <= s <= 1 for s in out.values()) and out[0] == out[1] == out[2] == 0
    assert toxicity.score(none, net).count() == 0
    assert 0 <= toxicity.score(docs, toxicity.train(docs, labels)).agg(F.max("score")).first()[0] <= 1
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).count() == len(TEXTS)


def test_language(docs, none):
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert out[0] == out[1] == out[2] == ("und", 0.0) and out[4][0] == "de"
    assert langid.identify(none, langid.train(none)).count() == 0 and langid.identify(docs, None).filter("lang_pred = 'und'").count() == len(TEXTS)


def test_rare_languages_are_classes(spark):
    rows = [(i, f"{BODY} {i}", "aa" if i % 2 else "bb") for i in range(4000)] + [(4000 + i, "ß ü ö ä " * 30 + str(i), f"rare{i % 3}") for i in range(6)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=40)
    assert net.classes == ["aa", "bb", "rare0", "rare1", "rare2"]


def test_multikey_quicksort():
    r = np.random.default_rng(8)
    for alphabet, n, length in (("ab", 3000, 100), ("a", 300, 12), ("abcdefgh", 2000, 20), ("ab", 1, 100)):
        raw = np.frombuffer("".join(r.choice(list(alphabet), 4000)).encode(), np.uint8)
        raw = np.concatenate([raw, raw[:2000]])
        at = r.integers(0, len(raw) - length, n)
        order, same = suffix_dedup.multikey_sorted(raw, at, length)
        strings = [raw[x : x + length].tobytes() for x in at]
        assert order.tolist() == sorted(range(n), key=lambda i: strings[i])
        assert same.tolist() == [i > 0 and strings[order[i]] == strings[order[i - 1]] for i in range(n)]


def test_long_texts_are_read_in_parts():
    """The parts of a long text give what the whole text gives."""
    import pyarrow as pa

    from lograil.llm import common
    from lograil.llm.queries import tokenizer_path

    r = np.random.default_rng(9)
    text = " ".join("".join(r.choice(list("abcdef,."), int(k))) for k in r.integers(1, 12, 3000))
    raw, bounds = common.text_buffers(pa.array([text]))
    w, p = packing.WordIds(tokenizer_path()), common.Powers()
    parts = list(packing.spans(raw, 500))
    assert len(parts) > 20 and np.array_equal(np.concatenate([w.of(raw[a:b], np.array([0, b - a]))[0] for a, b in parts]), w.of(raw, bounds)[0])
    assert w.of(raw, bounds)[0].tolist() == w.ids_of(text)
    net = toxicity.GatedNet().learn([f"{BODY[:80]} idiot {i}" if i % 2 else f"{BODY[80:200]} {i}" for i in range(40)], np.arange(40) % 2, steps=20)
    best = lambda parts: max(float(net.logits(toxicity.Words(raw[a:b], np.array([0, b - a]), p))[0].max()) for a, b in parts)
    assert len(list(toxicity.parts_of(raw, 700))) > 5 and abs(best(toxicity.parts_of(raw, 700)) - best([(0, len(raw))])) < 1e-5
    starts = lambda got, at: {int(s) + at + i for s, n in zip(got[3], got[4]) for i in range(n)}
    cut = [starts(suffix_dedup.anchor_records(raw[at : at + 1000 + 99], np.array([0, len(raw[at : at + 1000 + 99])]), p), at) for at in range(0, len(raw), 1000)]
    assert set().union(*cut) == starts(suffix_dedup.anchor_records(raw, bounds, p), 0) == set(range(len(raw) - 99)) and sum(map(len, cut)) == len(raw) - 99


def windows_of(text):
    ws = [x for x in re.sub("[A-Z]", lambda m: m[0].lower(), text).split()]
    n = 1 if len(ws) <= toxicity.WINDOW else 1 + math.ceil((len(ws) - toxicity.WINDOW) / (toxicity.WINDOW - toxicity.OVERLAP))
    return [ws[k * 24 : k * 24 + 32] for k in range(n)]


def test_toxicity_network_by_brute_force():
    """Gates and attention word by word in plain loops, and gradients by differences."""
    import pyarrow as pa

    from lograil.llm import common

    texts = [f"{BODY[:150]} idiot clown {i}" if i % 2 else f"{BODY[80:300]} {i}" for i in range(60)]
    net = toxicity.GatedNet().learn(texts, np.arange(60) % 2, steps=30)
    text = BODY + " idiot " + BODY[:90]
    raw, bounds = common.text_buffers(pa.array([text]))
    w = toxicity.Words(raw, bounds, common.Powers())
    x = net.vectors(net.word_kinds.find(w.word), net.gram_kinds.find(w.grams), w.n_grams).astype(float)
    got, _ = net.logits(w)
    H, s = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    win, _ = w.windows()
    assert len(win) == len(windows_of(text)) and [sum(r >= 0) for r in win] == [len(x) for x in windows_of(text)]
    for row, logit in zip(win, got):
        seq = [x[i] for i in row if i >= 0]
        states = []
        for d, items in (("f", seq), ("b", seq[::-1])):
            h, out = np.zeros(H), []
            for v in items:
                g, q = v @ net.p[f"W{d}"] + net.p[f"k{d}"], h @ net.p[f"U{d}"]
                z, r = s(g[:H] + q[:H]), s(g[H : 2 * H] + q[H : 2 * H])
                h = h + z * (np.tanh(g[2 * H :] + r * q[2 * H :]) - h)
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        hs = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1)
        e = np.tanh(hs @ net.p["A"] + net.p["a"]) @ net.p["v"]
        a = np.exp(e - e.max())
        assert logit == pytest.approx((a / a.sum()) @ hs @ net.p["w"] + net.p["c"][0], abs=1e-3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y = np.array([1.0, 0.0, 1.0])[: len(win)]
    _, g, dx = net.gradients(x, win[:3], y)
    for name, k in (("Wf", 5), ("Ub", 7), ("kf", 3), ("A", 4), ("a", 2), ("v", 1), ("w", 6), ("c", 0)):
        flat, eps = net.p[name].reshape(-1), 1e-4
        kept = flat[k]
        flat[k] = kept + eps
        up = net.gradients(x, win[:3], y)[0]
        flat[k] = kept - eps
        assert np.asarray(g[name]).reshape(-1)[k] == pytest.approx((up - net.gradients(x, win[:3], y)[0]) / (2 * eps), rel=0.02, abs=2e-5), name
        flat[k] = kept


def test_language_network_by_brute_force():
    """Convolutions byte by byte in plain loops, and gradients by differences."""
    r = np.random.default_rng(1)
    net = langid.ByteNet(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.fold()
    x = r.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    x[1, 100:] = 0
    e = net.p["E"].copy()
    e[0] = 0
    for row, got in zip(x, net.probabilities(x)):
        h = []
        for w in langid.WIDTHS:
            sums = np.array([sum(e[row[i + j]] @ net.p[f"W{w}"][j] for j in range(w)) for i in range(langid.WINDOW - w + 1)])
            h += np.maximum(sums.max(axis=0) + net.p[f"b{w}"], 0).tolist()
        z = np.exp(np.array(h) @ net.p["O"] + net.p["o"])
        assert got == pytest.approx(z / z.sum(), abs=1e-5)
    net.learning, y = True, np.array([0, 2, 1])
    _, g = net.gradients(x, y)
    for name, k in (("O", 4), ("o", 1), ("W3", 17), ("b4", 3), ("E", int(x[0, 50]) * langid.EMBED + 2)):
        flat, eps = net.p[name].reshape(-1), 1e-6
        kept = flat[k]
        flat[k] = kept + eps
        up = net.gradients(x, y)[0]
        flat[k] = kept - eps
        assert g[name].reshape(-1)[k] == pytest.approx((up - net.gradients(x, y)[0]) / (2 * eps), rel=0.02, abs=1e-5), name
        flat[k] = kept
