"""SimHash groups, tokenizer alignment and phrases against brute force, on hard cases: nulls, empty and long texts, ties, repeated rows and ids, clashing columns, empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from lograil.llm import alignment, common, phrases, queries, simhash

BODY = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "One", "two Words", "two words", BODY, BODY, BODY.replace("word30", "other"), BODY.upper() + " tail", "a a a a a b", "a\x0ba\x0ca", "naïve Ünïcode ▁ text", "naïve ünïcode text", "<s> </s> <|endoftext|> <unk>",
    "  two  blanks\t\ttabs \r\n\r\n end ", "日本語のテキスト。", "👍🏽 x" * 5, "<0x41> A", "it's we'll  don't  ", "x" * 300, "é  nbsp   wide", "\x00 odd",
]
SCHEMA = "doc_id long, text string, lang string, fp long, id long, key long, `table` int, row long, pair long, pairs string, at int, part long, phrase string, n long, head long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, *[k] * 6, "x", k, k, "y", k, k) for k, (i, t, lang) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 0 else "und" if i % 4 == 1 else "en") for i, t in enumerate(TEXTS)]
    rows += [(7, BODY + " more", "en"), (7, "quite another text here", "en"), (None, BODY, "en"), (None, None, None), (3, "One", None), (99, "ab " * 2000, "de"), (100, "longtext" * 3000 + " " + BODY, "fr")]
    return table(spark, rows).repartition(5)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_fingerprint(t):
    w = words(t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    """Groups of places whose fingerprints are linked, by search."""
    seen, out = set(), []
    for i in range(len(fps)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            k = todo.pop()
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= radius):
                if int(j) not in group:
                    group.add(int(j))
                    todo.append(int(j))
        seen |= group
        out.append(group)
    return out


def test_simhash_groups(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = np.array([brute_fingerprint(r["text"]) for r in rows], np.uint64)
    named = [k for k, r in enumerate(rows) if r["doc_id"] is not None]
    want = Counter((None, f"{int(fps[k]):016x}", None) for k in range(len(rows)) if k not in named)
    for group in components(fps[named], 3):
        low = min(rows[named[k]]["doc_id"] for k in group)
        want.update((rows[named[k]]["doc_id"], f"{int(fps[named[k]]):016x}", low) for k in group)
    assert Counter(map(tuple, simhash.near_groups(docs).collect())) == want
    assert want[(1, "0" * 16, 0)] == want[(2, "0" * 16, 0)] == 1


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_masks_miss_no_pair(radius):
    from itertools import combinations

    masks = simhash.covering_masks((1 << 64) - 1, radius)
    assert all(any(not m & sum(1 << b for b in bits) for m in masks) for bits in combinations(range(64), radius))
    assert max(64 - m.bit_count() for m in map(int, simhash.Tables(2, 3).masks)) <= 8


@pytest.mark.parametrize("bucket,dense", [(1024, 200), (8, 900)])
def test_simhash_links_lose_nothing(spark, monkeypatch, bucket, dense):
    """Clusters of chains, and a dense region whose buckets are deepened level by level."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    fps = [int(x) for x in rng.integers(0, 2**63, 150)]
    for x in fps[:80]:
        for _ in range(int(rng.integers(1, 12))):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps += [fps[0] ^ int(m) for m in rng.integers(0, 2**13, dense)]
    fps = np.array(sorted(set(fps)), np.uint64)
    links = simhash.near_links(spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)})).repartition(3)).toPandas()
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    assert (np.bitwise_count(links["src"].to_numpy().view(np.uint64) ^ links["dst"].to_numpy().view(np.uint64)) <= 3).all()
    near = defaultdict(set)
    for a, b in zip(links["src"].map(place), links["dst"].map(place)):
        near[a].add(b)
        near[b].add(a)
    label = {}
    for k in range(len(fps)):
        todo = [k] if k not in label else []
        while todo:
            x = todo.pop()
            if label.setdefault(x, k) == k:
                todo += [y for y in near[x] if y not in label]
    got = defaultdict(set)
    for k, x in label.items():
        got[x].add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, components(fps, 3)))


def test_fingerprints_in_parts(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole = simhash.fingerprint(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(simhash, "SPAN", 100)
    assert simhash.fingerprint(np.frombuffer(text, np.uint8)) == whole == brute_fingerprint(text.decode())
    short = b"one" + b" " * 500 + b"two"
    assert simhash.fingerprint(np.frombuffer(short, np.uint8)) == brute_fingerprint("one two")


PATHS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def brute_alignment(s, text):
    """(a ids, b ids, groups) of a text, by walking over both sides' ends."""
    if not text:
        return [], [], []
    a, b, want = s.a.encode(" " + text, add_special_tokens=False).ids, s.b.encode(text), (" " + text).encode()
    if b"".join(s.a_bytes[i] for i in a) != want or b"".join(s.b_bytes[i] for i in b) != want:
        return [], [], []
    ends_a, ends_b = np.cumsum([len(s.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(s.b_bytes[i]) for i in b]).tolist()
    groups, i, j = [], 0, 0
    for x in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(x, i) + 1, ends_b.index(x, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


@pytest.mark.parametrize("batch", [8 << 20, 500])
def test_alignment(docs, monkeypatch, batch):
    monkeypatch.setattr(alignment, "BATCH", batch)
    s = alignment.Sides(*PATHS)
    rows = [(r["doc_id"], *brute_alignment(s, r["text"])) for r in docs.select("doc_id", "text").collect()]
    counts = Counter((ga[-1], gb[-1]) for _, _, _, groups in rows for ga, gb in groups)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = Counter()
    for i, a, b, groups in rows:
        links = [(ga[-1], gb[-1]) for ga, gb in groups]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        want[(i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else "")] += 1
    assert Counter(map(tuple, alignment.align(docs, *PATHS).collect())) == want
    assert sum(not a for _, a, _, _ in rows) == 4  # two nulls, an empty one, and the text with U+2581
    assert len(counts) <= s.possible_pairs()


def test_overlaps_are_all():
    s = alignment.Sides(*PATHS)
    texts = [t for t in TEXTS if t and "▁" not in t]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    got = alignment.aligned(s, *alignment.with_blank(raw, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])))
    want = {(i, j) for i in range(len(got.a.id)) for j in np.flatnonzero((got.b.at < got.a.end[i]) & (got.a.at[i] < got.b.end) & (got.b.doc == got.a.doc[i])).tolist()}
    pairs = list(zip(got.overlaps[0].tolist(), got.overlaps[1].tolist()))
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert set(zip(*(x.tolist() for x in got.links))) == {(i, j) for i, j in want if got.a.end[i] == got.b.end[j]}


def test_segments_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    s = alignment.Sides(*PATHS)
    for text in (BODY, "other words come here", BODY):
        raw, at = alignment.with_blank(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        (a, _), (b, _) = s.encode(raw, at)
        assert (a.tolist(), b.tolist()) == (s.a.encode(" " + text).ids, s.b.encode(text))


def brute_phrases(rows, least, longest, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.mark.parametrize("lookup", [phrases.LOOKUP, 0])
@pytest.mark.parametrize("least,percent,top", [(2, 100, 2000), (3, 50, 7)])
def test_phrases(spark, docs, lookup, least, percent, top):
    rng = np.random.default_rng(3)
    more = [(None, " ".join(rng.choice(["a", "B", "c,", "d", "é.", "E!\n", "f\tg"], 40)), rng.choice(["en", "de", None])) for _ in range(12)]
    both = docs.filter("doc_id is null or doc_id < 99").unionByName(table(spark, [(i, t, None if lang is None else str(lang)) for i, t, lang in more]))
    rows = [(r["lang"], r["text"]) for r in both.collect()]
    got = [tuple(r) for r in phrases.collocations(both, least, 5, percent, top, lookup=lookup).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, least, 5, percent, top))


def test_parts_end_where_pieces_end(monkeypatch):
    monkeypatch.setattr(phrases, "PART", 10)
    text = b"one two three four. five six, seven eight nine ten eleven twelve! x"
    parts = list(phrases.parts_of(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    assert [text[lo:hi] for _, lo, hi in parts] == [b"one two three four.", b" five six, seven eight nine ten eleven twelve!", b" x"]
    assert list(phrases.parts_of(np.zeros(0, np.uint8), np.array([0, 0]))) == [(0, 0, 0)]


def test_no_rows(docs):
    none = docs.limit(0)
    assert simhash.near_groups(none).count() == alignment.align(none, *PATHS).count() == phrases.collocations(none).count() == 0
    nulls = docs.filter("text is null")
    assert phrases.collocations(nulls, 1).count() == 0
    assert alignment.align(nulls, *PATHS).agg(F.sum("n_a")).first()[0] == 0
