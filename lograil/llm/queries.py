"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.llm import alignment, fingerprints, langid, line_dedup, mixing, near_dedup, packing, phrases, quality, simhash, suffix_dedup, toxicity, warc
from lograil.llm.common import shared_dir


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_docs(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_docs(spark, sf_dir), shingle=4, percent=80)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_docs(spark, sf_dir), tokenizer_path()))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = warc.write_archives(pages, warc.fresh_path(shared_dir(spark)))
    return warc.resolved(warc.read_archives(spark, path))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = toxicity.bucket("doc_id", 5) == 0
    net = toxicity.train(docs, labels.filter(~held))
    out = toxicity.score(docs, net)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    runs = F.array_join(F.col("keep_runs").cast("array<string>"), ",").alias("keep_runs")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.coalesce(runs, F.lit("")).alias("keep_runs"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    held = toxicity.bucket("doc_id", 3) == 1
    net = langid.train(docs.filter(~held))
    return langid.identify(docs, net).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_docs(spark, sf_dir), size=3, radius=3)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_docs(spark, sf_dir), least=100, longest=5, percent=100, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_near_dedup, op3_suffix_dedup, op4_packing, op5_warc, op6_toxicity, op7_mixing, op8_quality, op9_line_dedup, op10_language, op11_simhash, op12_alignment, op13_phrases)}


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

_OP2 = f"""
with recursive words as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents),
shingles as (select distinct doc_id, case when len(w) < 4 then w else w[i : i + 3] end s from
  (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from words where len(w) > 0)),
sizes as (select doc_id, count(*) n from shingles group by 1),
pairs as (select a.doc_id a, b.doc_id b, count(*) n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * pairs.n >= 80 * (x.n + y.n - pairs.n)),
sides as (select a, b from links union all select b, a from links),
reach as (select doc_id a, doc_id b from documents union select reach.a, sides.b from reach join sides on reach.b = sides.a),
least as (select a, min(b) component_id from reach group by 1)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from documents left join sizes using (doc_id) join least on a = doc_id
"""

_SIZES = r"select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint h from documents"
_OP7 = f"""
with recursive base as ({_SIZES}),
sources as (select source, sum(size)::double source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 w from base group by 1),
rounds(k, source, source_size, w, target, full_) as (
  select 0, source, source_size, w, 0.0::double, false from sources
  union all
  select k + 1, source, source_size, w, case when full_ then target else least(3 * source_size, part) end, full_ or part >= 3 * source_size
  from (select *, w * (total - sum(case when full_ then target else 0.0 end) over ()) / nullif(sum(case when full_ then 0 else w end) over (), 0) part
        from (select *, sum(source_size) over () total from rounds)) where k < (select count(*) from sources) + 1),
targets as (select source, source_size, target from rounds where k = (select max(k) from rounds)),
plan as (select *, case when source_size > 0 then floor(target / source_size + 1e-12) else 0 end whole from targets),
hashes as (select source, h, sum(size) words from base group by 1, 2),
runs as (select source, h, words, sum(words) over (partition by source order by h) upto from hashes),
picked as (select r.source, r.h, target - whole * source_size budget, upto, words, whole,
  case when upto <= target - whole * source_size then 1 when upto - words <= target - whole * source_size and upto - (target - whole * source_size) < (target - whole * source_size) - (upto - words) then 1 else 0 end more
  from runs r join plan p on r.source is not distinct from p.source)
select b.doc_id, b.size, p.source_size::bigint source_size, round(p.target, 4) target, (b.size * case when p.source_size > 0 then least(3, k.whole + k.more) else 0 end)::bigint taken
from base b join plan p on b.source is not distinct from p.source join picked k on k.source is not distinct from b.source and k.h = b.h
"""

_CUTOFFS = " union all ".join(f"select '{r}' rule, {j} j, {c}::double cutoff" for r, cs in quality.RULES.items() for j, c in enumerate(cs))
_UNPIVOT = " union all ".join(f"select doc_id, stratum, base_failed, '{r}' rule, {v}::double v from failed" for r, v in {
    "symbol_share": "case when word_chars > 0 then n_symbols / word_chars else 0 end", "dup_line_share": "case when n_lines > 0 then n_dup_lines / n_lines else 0 end",
    "repeat_share": "case when n_words > 0 then n_repeat_words / n_words else 0 end", "upper_share": "case when word_chars > 0 then n_upper / word_chars else 0 end",
    "mean_word_chars": "case when n_words > 0 then word_chars / n_words else 0 end"}.items())
_OP8 = rf"""
with d as (select doc_id, lang stratum, coalesce(text, '') t from documents),
w as (select *, {_WORDS.format("t")} w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
grams as (select doc_id, i, w[i : i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from grams) where n > 1),
repeats as (select doc_id, count(distinct i + o) n from twice, (values (0), (1), (2)) v(o) group by 1),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from (
  select w.doc_id, stratum, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words, len(l)::bigint n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint n_upper
  from w left join repeats using (doc_id))),
vals as ({_UNPIVOT}),
grid as ({_CUTOFFS}),
overs as (select doc_id, stratum, base_failed, rule, count(*) filter (v > cutoff) n_over from vals join grid using (rule) group by all),
steps as (select *, case when n_over > 0 then ({quality.STEPS} // {len(quality.RULES)} - n_over) * {len(quality.RULES)} + list_position([{", ".join(repr(r) for r in quality.RULES)}], rule) - 1 else {quality.STEPS} end step from overs),
firsts as (select stratum, min(step) step from steps where not base_failed and doc_id in (select doc_id from labels where quality = 1) group by doc_id, stratum),
hist as (select stratum, step, sum(count(*)) over (partition by stratum order by step) k, sum(count(*)) over (partition by stratum) n from firsts group by 1, 2),
level as (select 0.05 / (select count(*) from (select distinct stratum from hist)) a),
tails as (select *, case when k >= n * 0.05 then 1.0 else
  list_sum(list_transform(range(0, k::bigint + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) end tail from hist),
cuts as (select stratum, case when pow(0.95, n) <= (select a from level) then coalesce(min(step) filter (tail > (select a from level) and step < {quality.STEPS}), {quality.STEPS}) - 1 else -1 end last_ from tails group by stratum, n),
bad as (select doc_id, string_agg(rule, ',' order by step % {len(quality.RULES)}) rules from steps s join cuts c on c.stratum is not distinct from s.stratum where step <= last_ group by 1)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rules is null kept, coalesce(rules, '') failed_rules from failed f left join bad using (doc_id)
"""

_OP9 = f"""
with lines as (select doc_id, unnest(l) line, unnest(range(0, len(l))) pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents)),
keys as (select *, {_LOWER.format(_TRIM.format("line"))} k from lines),
hot as (select k, max(doc_id) top from keys where length(k) >= 40 group by 1 having count(distinct doc_id) >= 5),
marked as (select doc_id, line, pos, hot.k is not null and doc_id < top dropped from keys left join hot using (k)),
islands as (select doc_id, dropped, count(*) n, min(pos) lo from (select *, pos - row_number() over (partition by doc_id, dropped order by pos) g from marked) group by doc_id, dropped, g),
runs as (select doc_id, string_agg(case when dropped and lo = 0 then '0,' || n else n::varchar end, ',' order by lo) r from islands i
  where exists (select 1 from islands j where j.doc_id = i.doc_id and j.dropped and j.lo >= i.lo) group by 1)
select doc_id, count(*) n_lines, count(*) filter (dropped) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) kept_sha256, coalesce(any_value(r), '') keep_runs
from marked left join runs using (doc_id) group by doc_id
"""


_OP3 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x, octet_length(encode(coalesce(text, ''))) n from documents),
strings as (select doc_id, p, md5(substr(x, 2 * p + 1, 200)) s from (select doc_id, x, unnest(range(0, n - 99)) p from d where n >= 100)),
again as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) r from strings) where r > 1),
spans as (select doc_id, min(p) lo, max(p) + 100 hi from (select doc_id, p, sum(new) over (partition by doc_id order by p) g from
  (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end new from again)) group by doc_id, g),
sums as (select doc_id, sum(hi - lo) n_removed, count(*) n_spans from spans group by 1),
kept as (select doc_id, lo, lead(lo) over (partition by doc_id order by lo) next, hi from spans),
pieces as (select doc_id, hi lo, coalesce(next, n) hi from kept join d using (doc_id) union all select doc_id, 0, min(lo) from spans group by 1),
texts as (select doc_id, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' order by lo) y from pieces join d using (doc_id) group by 1)
select d.doc_id, n n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(y, x))) kept_sha256 from d left join sums using (doc_id) left join texts using (doc_id)
"""

_LETTERS = " || ".join(f"substr('{warc.BASE32}', ((('0x' || substr(d, {5 * g + 1}, 5))::bigint >> {15 - 5 * k}) & 31)::int + 1, 1)" for g in range(8) for k in range(4))
_OP5 = f"""
with d as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) d from pages),
heads as (select page_id, payload_bytes, {_LETTERS} payload_digest, max(page_id) over (partition by d) top from d)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end record_type, case when page_id <> top then top end refers_to from heads
"""

_OP13 = r"""
with pieces as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') w from pieces),
totals as (select lang, sum(len(w))::hugeint n from words group by 1),
grams as (select lang, k, array_to_string(w[i : i + k - 1], ' ') phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from words, range(1, 6) t(k) where len(w) >= k)),
f as (select lang, k, phrase, count(*)::hugeint f from grams group by 1, 2, 3 having count(*) >= 100),
longer as (select lang, k - 1 k, array_to_string(string_split(phrase, ' ')[o : o + k - 2], ' ') phrase, max(f) top from f, (values (1), (2)) v(o) where k > 2 group by 1, 2, 3),
cand as (select f.lang, f.k, f.phrase, f.f a, n from f join totals using (lang) left join longer on longer.lang = f.lang and longer.k = f.k and longer.phrase = f.phrase where f.k > 1 and (top is null or 100 * top < 100 * f.f)),
cuts as (select cand.*, c, x.f l, y.f r, (1000 * a * n) // (x.f * y.f) score from cand, range(1, 5) t(c), f x, f y
  where c < cand.k and x.lang = cand.lang and x.phrase = array_to_string(string_split(cand.phrase, ' ')[1 : c], ' ') and y.lang = cand.lang and y.phrase = array_to_string(string_split(cand.phrase, ' ')[c + 1 : cand.k], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from best qualify rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": _OP2, "op3_suffix_dedup": _OP3, "op5_warc": _OP5, "op7_mixing": _OP7, "op8_quality": _OP8, "op9_line_dedup": _OP9, "op13_phrases": _OP13}
