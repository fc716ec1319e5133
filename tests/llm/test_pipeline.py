"""The corpus pipeline against a plain version of all its stages, and its stages on hard cases."""

import hashlib
import re
import zlib

import corpus_pipeline as C
import numpy as np
import pyarrow as pa
import pytest

from lograil.llm import common, packing, toxicity
from lograil.llm.queries import tokenizer_path

LINE = "a line that is long enough to count as repeated text here"
BODY = " ".join(f"word{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, net, weights=(1, 2, 3)):
    """(doc_id, text) of all documents that the pipeline packs, as often as it takes them."""
    p = common.Powers()

    def toxic(t):
        raw, bounds = common.text_buffers(pa.array([t or ""]))
        logits, _ = net.logits(toxicity.Words(raw, bounds, p))
        return len(logits) > 0 and logits.max() >= 0

    rows = [r for r in rows if not toxic(r["text"])]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(r["doc_id"])
    gone = lambda x, i: len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != i
    docs = []
    for r in rows:
        parts = (r["text"] or "").split("\n")
        keep = [x for x in parts if not gone(x, r["doc_id"])]
        docs.append((r["doc_id"], r["source"], "\n".join(keep) if len(keep) < len(parts) else r["text"]))
    sets = []
    for _, _, t in docs:
        w = words(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    least = list(range(len(docs)))
    find = lambda i: i if least[i] == i else find(least[i])
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    for a, i in enumerate(order):
        for j in order[:a]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                least[max(x, y, key=lambda k: docs[k][0])] = min(x, y, key=lambda k: docs[k][0])
    docs = [d for i, d in enumerate(docs) if find(i) == i]
    sources = sorted({s for _, s, _ in docs if s is not None}) + [None] * any(s is None for _, s, _ in docs)
    size = {s: sum(len(words(t)) for _, x, t in docs if x == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, open_, total = {}, set(sources), sum(size.values())
    while open_:
        part = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] >= 3 * size[s]}
        if not full:
            target |= part
            break
        target |= {s: 3.0 * size[s] for s in full}
        open_ -= full
    out = []
    for s in sources:
        if not size[s]:
            continue
        whole = int(target[s] / size[s] + 1e-12)
        budget, upto = target[s] - whole * size[s], 0
        mine = sorted((d for d in docs if d[1] == s), key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest()[:15])
        open_more = True
        for i, _, t in mine:
            n = len(words(t))
            more = open_more and (upto + n <= budget or upto + n - budget < budget - upto)
            if upto + n > budget:
                open_more = False
            upto += n
            out += [(i, t)] * min(3, whole + more)
    return out


def test_pipeline_by_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.train(docs, labels.filter(toxicity.bucket("doc_id", 5) != 0))
    taken = brute(docs.collect(), net)
    ids = packing.WordIds(tokenizer_path())
    want = []
    for i, t in taken:
        x = [*ids.ids_of(t or ""), 0]
        want += [(i, k, a, len(x[a : a + 2048]), zlib.crc32(np.array(x[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(x), 2048))]
    got = C.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by) <= 1.05 * -(-sum(x[3] for x in want) // 2048) + 1


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Nulls in any column, empty texts, repeated rows and ids, ties, and columns with the names that the stages use inside."""
    rows = [
        (1, BODY, "de", "a", 7), (1, BODY, "de", "a", 7), (2, BODY + " tail", None, None, None), (None, BODY, "de", "a", 1), (None, None, None, None, None), (3, None, "de", "b", None), (4, "", "de", "b", 0), (5, " \n ", None, "b", 3),
        *[(10 + k, f"{LINE}\nown {k}", "de", "c", 9) for k in range(6)], (20, "x " * 5000, "de", "d", 10000), (20, "other text of one id " * 20, "de", "d", 400),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("_id", "_source", "_row", "row", "id", "times", "kept", "kept_text", "n_lines", "_toxicity", "_copy", "size", "text_"):
        docs = docs.withColumn(name, docs["n_chars"])
    path = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(10, 0), (11, 1), (12, 0), (None, 1), (1, None), (20, 0)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, path


def test_stages_on_hard_cases(spark, hard):
    docs, path = hard
    n = docs.count()
    lines = C.drop_repeated_lines(spark, docs, path)
    texts = sorted((r["text"] for r in lines.filter("doc_id between 10 and 15").collect()), key=len)
    assert lines.count() == n and lines.columns == list(C.COLUMNS) and texts[-1] == f"{LINE}\nown 5" and texts[:5] == sorted(f"own {k}" for k in range(5))
    near = C.drop_near_copies(spark, docs, path)
    assert near.columns == list(C.COLUMNS)
    kept = sorted(((r["doc_id"], (r["text"] or "")[:12]) for r in near.collect()), key=str)
    # One of the two equal rows and its near copy, and one of the six texts of one line that share 9 of 11 runs of words; null ids, texts without words and the other rows stay.
    assert [k for k in kept if k[0] in (1, 2)] == [(1, BODY[:12])] and [k[0] for k in kept if k[0] in range(10, 16)] == [10] and len(kept) == n - 2 - 5
    mixed = C.mix_sources(spark, docs, path)
    assert mixed.columns == list(C.COLUMNS)
    sizes = {r["source"]: r["n"] for r in mixed.groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert all(r <= 3 * n for r in sizes.values())
    packed = C.pack_sequences(spark, docs, path)
    assert packed.filter("piece = 0").count() == n and packed.filter("doc_id is null").count() == 2
    clean = C.drop_toxic(spark, docs, path)
    assert clean.columns == list(C.COLUMNS) and clean.filter("text is null or trim(text) = '' or doc_id = 5").count() == 4


def test_stages_on_no_rows(spark, hard):
    docs, path = hard
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


def test_run_follows_the_stages(spark, sf_dir):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
