"""Registered queries over the given tables, with DuckDB SQL for each where SQL can express it."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.functions import kinds, times
from lograil.functions import predicates as P
from lograil.operators import blocked, context, detect, ingest, matchsets, records, rules, sinks, stats
from lograil.plans.fixtures import document_lines, event_fields, event_lines, spread, table, with_continuations
from lograil.shared import materialize, own_path
from lograil.sources import lines as sources
from lograil.streaming import live, merged, views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Lines of a block here; small, so that small tables have many blocks.
BLOCK = 4096

_EVENTS = """(select *, 'app-' || (user_id % 4) source, event_id * 4 line_no, json_extract_string(props, '$.k') k,
  case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'INFO' when 'click' then 'DEBUG' else 'TRACE' end level,
  case event_type when 'error' then 4 when 'purchase' then 3 when 'signup' then 2 when 'click' then 1 else 0 end level_rank,
  case event_type when 'error' then '500' when 'purchase' then '404' when 'signup' then '301' else '200' end status from events)"""
_LINES = "(select doc_id source, unnest(l) raw, unnest(range(0, len(l)))::bigint line_no from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents))"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


LOGFMT = ("ts", "level", "user", "dur", "k", "msg")


@query(f"""select level, count(*) n, count(distinct user_id) users, round(quantile_disc(value, 0.5) * 1e6, 3) p50, round(quantile_disc(value, 0.9) * 1e6, 3) p90, round(quantile_disc(value, 0.99) * 1e6, 3) p99
from {_EVENTS} where level_rank >= 3 and value > 250 group by level""")
def q_level_duration(spark, d):
    r = ingest.logfmt(event_lines(spark, d, "logfmt"), LOGFMT)
    r = r.filter(P.all_of(P.compare(F.col("level"), ">=", "warn", "level"), P.compare(F.col("dur"), ">", "250ms", "duration")))
    r = r.withColumns({"label": kinds.level_label(F.col("level")), "ns": kinds.duration_ns(F.col("dur"))})
    pct = [F.round(F.expr(f"percentile_disc({p}) within group (order by ns)"), 3).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    return r.groupBy(F.col("label").alias("level")).agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"), *pct)


@query(f"select source, line_no, epoch_us(ts) us, level_rank, user_id::varchar \"user\", round(value * 1e6, 3) ns, k, 'event ' || event_id || ' \"' || event_type || '\"' msg from {_EVENTS}")
def q_ingest_logfmt(spark, d):
    r = ingest.logfmt(event_lines(spark, d, "logfmt"), LOGFMT).filter("is_record")
    return r.select("source", "line_no", F.unix_micros(times.cell_instant(F.col("ts"))).alias("us"), kinds.level_rank(F.col("level")).alias("level_rank"), "user", F.round(kinds.duration_ns(F.col("dur")), 3).alias("ns"), "k", "msg")


@query(f"select source, line_no, epoch_us(ts) us, level_rank, user_id::varchar user_id, round(value, 2) dur, k, 'event ' || event_id msg from {_EVENTS}")
def q_ingest_jsonl(spark, d):
    r = ingest.json_lines(event_lines(spark, d, "jsonl"), ("ts", "level", "user.id", "dur", "props.k", "msg")).filter("is_record")
    return r.select("source", "line_no", F.unix_micros(times.cell_instant(F.col("ts"))).alias("us"), kinds.level_rank(F.col("level")).alias("level_rank"), F.col("`user.id`").alias("user_id"), F.round(F.col("dur").cast("double"), 2).alias("dur"), F.col("`props.k`").alias("k"), "msg")


@query(f"select source, line_no, level, user_id::varchar \"user\", round(value, 2) dur, 'event ' || event_id || ', \"' || event_type || '\"' message from {_EVENTS}")
def q_ingest_csv(spark, d):
    r = ingest.delimited(event_lines(spark, d, "csv"), ("ts", "level", "user", "duration", "message")).filter("is_record")
    return r.select("source", "line_no", "level", "user", F.round(kinds.number(F.col("duration")), 2).alias("dur"), "message")


@query(f"select source, line_no, '10.0.0.' || user_id remote, epoch_us(date_trunc('second', ts)) us, 'GET' \"method\", '/' || event_type || '/' || event_id \"path\", status, floor(value)::bigint::varchar \"size\", 'agent/1.0' agent from {_EVENTS}")
def q_ingest_access(spark, d):
    r = ingest.access(event_lines(spark, d, "access")).filter("is_record")
    return r.select("source", "line_no", "remote", F.unix_micros(times.cell_instant(F.col("ts"))).alias("us"), "method", "path", "status", "size", "agent")


@query(f"select source, line_no, '11' pri, epoch_us(date_trunc('second', ts)) us, source host, 'svc' tag, user_id::varchar pid, 'event ' || event_id msg from {_EVENTS}")
def q_ingest_syslog(spark, d):
    r = ingest.syslog_3164(event_lines(spark, d, "syslog_3164")).filter("is_record")
    return r.select("source", "line_no", "pri", F.unix_micros(times.line_instant(F.col("raw"), "syslog", "2024-12-31")).alias("us"), "host", "tag", "pid", "msg")


@query(f"select source, line_no, '131' pri, epoch_us(ts) us, source host, 'svc' app, user_id::varchar procid, 'ID' || event_id msgid, '[m@1 k=\"' || k || '\"]' sd, 'event ' || event_id msg from {_EVENTS}")
def q_ingest_syslog5424(spark, d):
    r = ingest.syslog_5424(event_lines(spark, d, "syslog_5424")).filter("is_record")
    return r.select("source", "line_no", "pri", F.unix_micros(times.cell_instant(F.col("ts"))).alias("us"), "host", "app", "procid", "msgid", "sd", "msg")


@query(f"select source, line_no, epoch_us(ts) // 1000 ms, level, 'worker-' || user_id thread, 'app.Svc' logger, 'event ' || event_id msg from {_EVENTS}")
def q_ingest_log4j(spark, d):
    r = ingest.log4j(event_lines(spark, d, "log4j"), "%d %-5p [%t] %c - %m%n").filter("is_record")
    return r.select("source", "line_no", F.unix_millis(times.cell_instant(F.col("ts"))).alias("ms"), "level", "thread", "logger", "msg")


@query(f"select source, line_no, strftime(ts, '%Y-%m-%d') \"date\", strftime(ts, '%H:%M:%S') \"time\", case when user_id % 10 <> 0 then user_id::varchar end \"user\", status, floor(value)::bigint::varchar taken from {_EVENTS}")
def q_ingest_w3c(spark, d):
    r = ingest.w3c(event_lines(spark, d, "w3c"), ("date", "time", "user", "sc-status", "time-taken")).filter("is_record")
    return r.select("source", "line_no", "date", "time", "user", F.col("sc-status").alias("status"), F.col("time-taken").alias("taken"))


@query(f"select source, line_no, level, user_id::varchar \"user\", round(value, 2) dur, 'event ' || event_id msg from {_EVENTS}")
def q_ingest_fixed(spark, d):
    r = ingest.fixed_width(event_lines(spark, d, "fixed"), (("level", 0, 6), ("user", 6, 13), ("dur", 13, 24), ("msg", 24, None))).filter("is_record")
    return r.select("source", "line_no", "level", "user", F.round(kinds.number(F.col("dur")), 2).alias("dur"), "msg")


@query(f"select source, line_no, user_id::varchar \"user\" from {_EVENTS} where user_id % 10 = 3 and length(user_id::varchar) = 2")
def q_ingest_regex(spark, d):
    r = ingest.by_regex(event_lines(spark, d, "logfmt"), r"user=(?P<user>\d3) ").filter("is_record")
    return r.select("source", "line_no", "user")


@query(f"select k, count(*) n from {_EVENTS} where k::int >= 50 group by k")
def q_extra_keys(spark, d):
    r = ingest.json_lines(event_lines(spark, d, "jsonl"), ("ts", "level")).filter("is_record")
    k = P.extra(F.col("extra"), "PROPS.K")
    return r.filter(P.compare(k, ">=", "50", "number")).groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("select 'app-' || (user_id % 4) source, name, nth from (select distinct user_id % 4 user_id from events), (values ('ts', 1), ('level', 2), ('user', 3), ('dur', 4), ('k', 5), ('msg', 6)) v(name, nth)")
def q_discover_keys(spark, d):
    lines = event_lines(spark, d, "logfmt")
    return ingest.discover_columns(lines, ingest.logfmt_pairs(F.col("raw")), sample=1 << 40)


@query(f"select source, line_no, raw from {_LINES} where contains(lower(raw), 'the') and regexp_matches(raw, '[0-9]{{3}}') and not contains(raw, '!!')")
def q_filter_stack(spark, d):
    raw = F.col("raw")
    return document_lines(spark, d).filter(P.filter_stack([P.text(raw, "the"), P.regex(raw, "[0-9]{3}")], [P.text(raw, "!!")]))


@query(f"select source, line_no from {_LINES} where regexp_matches(lower(raw), '(^|[^\\w\\x{{80}}-\\x{{10FFFF}}])(of)([^\\w\\x{{80}}-\\x{{10FFFF}}]|$)')")
def q_whole_word(spark, d):
    return document_lines(spark, d).filter(P.text(F.col("raw"), "of", whole_word=True)).select("source", "line_no")


@query(f"select count(*) filter (contains(lower(raw), 'license')) insensitive, count(*) filter (contains(raw, 'License')) \"sensitive\" from {_LINES}")
def q_smart_case(spark, d):
    raw = F.col("raw")
    return document_lines(spark, d).agg(F.count_if(P.text(raw, "license")).alias("insensitive"), F.count_if(P.text(raw, "License")).alias("sensitive"))


@query(f"select source, count(*) n from {_LINES} where contains(lower(raw), 'license') or contains(lower(raw), 'copyright') or contains(lower(raw), 'the ') group by source")
def q_any_literal(spark, d):
    return document_lines(spark, d).filter(P.any_literal(F.col("raw"), ["license", "copyright", "the "])).groupBy("source").agg(F.count("*").alias("n"))


@query("select o_orderpriority, count(*) n from orders where lower(o_orderpriority) like '%-%medium%' or lower(o_orderpriority) like '1-%' group by 1")
def q_wildcard(spark, d):
    c = F.col("o_orderpriority")
    return table(spark, d, "orders").filter(P.one_of(c, ["*-*MEDIUM*", "1-*"])).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_ALL = f"(select source, line_no, level_rank, 0 o from {_EVENTS} union all select source, line_no + o, null, o from {_EVENTS}, (values (1), (2), (3)) v(o) where event_type = 'error' and event_id % 7 = 0)"


@query(f"select count(*) n, count(*) filter (o > 0) continuations from {_ALL} where not coalesce(level_rank = 4, false)")
def q_not_keeps_continuations(spark, d):
    r = ingest.logfmt(with_continuations(event_lines(spark, d, "logfmt")), LOGFMT)
    r = r.filter(P.not_(P.equals(F.col("level"), "E", "level")))
    return r.agg(F.count("*").alias("n"), F.count_if(~F.col("is_record")).alias("continuations"))


@query(f"select count(*) n, sum(value) total from {_EVENTS} where ts >= (select min(ts) from events) and ts >= timestamp '2024-01-02' and ts <= timestamp '2024-01-03 06:00:00'")
def q_time_range(spark, d):
    e = table(spark, d, "events")
    return e.filter(P.time_range(F.col("ts"), "2024-01-02", "+30h")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""with l as {_LINES}, h as (select source, line_no from l where contains(lower(raw), 'license')),
m as (select l.source, l.line_no, min(case when l.line_no = h.line_no then 0 else 1 end) c from l join h on l.source = h.source and l.line_no between h.line_no - 2 and h.line_no + 1 group by 1, 2)
select source, line_no, c = 1 is_context, raw from m join l using (source, line_no)""")
def q_context(spark, d):
    lines = document_lines(spark, d)
    return records.with_context(lines, P.text(F.col("raw"), "license"), 2, 1).select("source", "line_no", "is_context", "raw")


@query(_SQL["q_context"])
def q_context_in_order(spark, d):
    """The same without an exchange of lines."""
    return context.context_in_order(document_lines(spark, d), P.text(F.col("raw"), "license"), 2, 1).select("source", "line_no", "is_context", "raw")


RULES = (
    rules.Rule("shout", "!!", priority=1, tag="noise", hide=True), rules.Rule("license", "license", priority=5, tag="legal"), rules.Rule("digits", r"[0-9]{4}", kind="regex", priority=5, tag="number", bookmark=True),
    rules.Rule("the", "the", whole_word=True, tag="word", alert=True), rules.Rule("off", "a", enabled=False),
)
_HITS = f"""(select *, contains(raw, '!!') r1, contains(lower(raw), 'license') r2, regexp_matches(raw, '[0-9]{{4}}') r3,
  regexp_matches(lower(raw), '(^|[^\\w\\x{{80}}-\\x{{10FFFF}}])the([^\\w\\x{{80}}-\\x{{10FFFF}}]|$)') r4 from {_LINES})"""


@query(f"select source, count(*) n from {_HITS} where not r1 group by source")
def q_hide_rules(spark, d):
    return rules.tag_lines(document_lines(spark, d), RULES).filter("not hidden").groupBy("source").agg(F.count("*").alias("n"))


@query(" union all ".join(f"select '{n}' \"rule\", count(*) n from {_HITS} where {r}" for n, r in (("shout", "r1"), ("license", "r2"), ("digits", "r3"), ("the", "r4"))))
def q_rule_hits(spark, d):
    return rules.rule_hits(rules.tag_lines(document_lines(spark, d), RULES))


@query(f"select tag, count(*) n, count(*) filter (r3) bookmarks, count(*) filter (r4) alerts from (select *, case when r3 then 'number' when r2 then 'legal' when r1 then 'noise' when r4 then 'word' end tag from {_HITS}) group by tag")
def q_rule_priority(spark, d):
    t = rules.tag_lines(document_lines(spark, d), RULES)
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.count_if("bookmark").alias("bookmarks"), F.count_if("alert").alias("alerts"))


@query(f"""with v as (select unnest(regexp_extract_all(raw, '{rules.ENTITIES["ipv4"]}')) "value" from {_LINES}), c as (select "value", count(*) n from v group by 1)
select "value", n, row_number() over (order by n desc, "value") nth from c qualify nth <= 20""")
def q_entities_top(spark, d):
    e = rules.entities(document_lines(spark, d), ["ipv4"])
    return stats.top_values(e, {"value": "text"}, 20).select("value", F.col("count").alias("n"), "nth")


@query(f"""select source, line_no rec_id, case when event_type = 'error' and event_id % 7 = 0 then 4 else 1 end n_lines from {_EVENTS}""")
def q_multiline(spark, d):
    lines = with_continuations(event_lines(spark, d, "logfmt"))
    return records.bodies(records.with_record(lines, records.record_start(F.col("raw"), ingest.is_logfmt(F.col("raw"))), BLOCK)).select("source", "rec_id", "n_lines")


_PROFILE = " union all ".join(
    f"select '{n}' \"name\", '{k}' kind, count({c}) \"count\", count(*) - count({c}) missing, count({v}) numeric_count, min({v}) \"min\", max({v}) \"max\", round(avg({v}), 6) mean, quantile_disc({v}, 0.5) p50, quantile_disc({v}, 0.9) p90, quantile_disc({v}, 0.99) p99 from lineitem"
    for n, k, c, v in (("l_quantity", "number", "l_quantity", "l_quantity::double"), ("l_extendedprice", "number", "l_extendedprice", "l_extendedprice::double"), ("l_returnflag", "text", "l_returnflag", "null::double"), ("l_discount", "duration", "l_discount", "(l_discount * 1e6)::double"))
)


@query(f"select \"name\", kind, \"count\", missing, numeric_count, round(\"min\", 6) \"min\", round(\"max\", 6) \"max\", mean, round(p50, 6) p50, round(p90, 6) p90, round(p99, 6) p99 from ({_PROFILE})")
def q_profile(spark, d):
    p = stats.profile(spread(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_discount")), {"l_quantity": "number", "l_extendedprice": "number", "l_returnflag": "text", "l_discount": "duration"}, exact=True)
    return p.select("name", "kind", "count", "missing", "numeric_count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "p50", "p90", "p99")])


@query()
def q_distinct_approx(spark, d):
    p = stats.profile(table(spark, d, "events"), {"user_id": "text", "event_type": "text"})
    return p.select("name", "distinct_estimate")


@query("""with c as (select 'o_orderstatus' "name", o_orderstatus "value", count(*) "count" from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2 union all select 'o_custkey', o_custkey::varchar, count(*) from orders group by 2)
select *, row_number() over (partition by "name" order by "count" desc, "value") nth from c qualify nth <= 10""")
def q_top_values(spark, d):
    return stats.top_values(table(spark, d, "orders"), {"o_orderstatus": "text", "o_orderpriority": "text", "o_custkey": "text"}, 10)


@query(f"""with l as (select *, coalesce(sum(strlen(raw) + 1) over (partition by source order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint off from {_LINES}),
t as (select source, sum(strlen(raw) + 1) size from l group by 1),
b as (select source, least(off * 10 // size, 9)::int bin, count(*) n from l join t using (source) where contains(lower(raw), 'the') group by 1, 2)
select source, bin, n, round(greatest(0.35, sqrt(n / max(n) over (partition by source))), 6) intensity from b""")
def q_density(spark, d):
    size = (F.octet_length("raw") + 1).cast("long")
    lines = blocked.running_sum(document_lines(spark, d), size, "byte_off", BLOCK)
    totals = lines.groupBy("source").agg(F.sum(size).alias("size"))
    return stats.density(lines.filter(P.text(F.col("raw"), "the")), totals, 10).withColumn("intensity", F.round("intensity", 6))


@query("select c_custkey, c_acctbal, row_number() over (order by c_acctbal desc nulls last, c_mktsegment, c_custkey) nth from customer qualify nth <= 500")
def q_sorted(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("line_no"), F.col("c_acctbal").cast("string").alias("cell"), "c_custkey", "c_acctbal")
    order = records.ranked(c, kinds.number(F.col("cell")).desc_nulls_last(), F.col("source").asc_nulls_last(), F.col("line_no"))
    return order.filter("nth <= 500").select("c_custkey", "c_acctbal", "nth")  # the SQL asks for the first 500


@query(f"""select source, n, line_no, nth from (select source, line_no, row_number() over (partition by source order by line_no) nth, count(*) over (partition by source) n from
(select 'role-' || role source, conv_id * 1000 + turn line_no, text raw from conversations) where contains(lower(raw), 'the')) where nth <= 100""")
def q_cross_search(spark, d):
    c = table(spark, d, "conversations").select(F.concat(F.lit("role-"), "role").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.col("text").alias("raw"))
    counts, first = stats.search_sources(c, P.text(F.col("raw"), "the"))
    return first.join(counts, "source").select("source", "n", "line_no", F.col("nth").cast("long").alias("nth"))


_MERGE = f"(select source, line_no, max(case when event_id % 5 <> 0 then ts end) over (partition by source order by line_no) eff from {_EVENTS})"


@query(f"select source, line_no, epoch_us(eff) us, row_number() over (order by eff nulls first, source, line_no) nth from {_MERGE}")
def q_merge(spark, d):
    e = event_fields(spark, d).select("source", "line_no", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("t"))
    m = records.effective_time(e, F.col("t"), BLOCK)
    m = m.select("source", "line_no", F.unix_micros("eff_ts").alias("us"))
    return records.ranked(m, F.col("us").asc_nulls_first(), F.col("source"), F.col("line_no"))


@query(f"select source, min(line_no) line_no from {_EVENTS} where ts >= timestamp '2024-01-02 12:00:00' group by source")
def q_goto_time(spark, d):
    return records.first_at_or_after(event_fields(spark, d), F.col("ts"), F.lit("2024-01-02 12:00:00").cast("timestamp"))


_LAG = f"(select source, line_no, epoch_us(ts) - epoch_us(lag(ts) over (partition by source order by line_no)) us from {_EVENTS})"


@query(f"select source, line_no, us gap_us from {_LAG} where us >= 600000000")
def q_gaps(spark, d):
    return records.gaps(event_fields(spark, d), F.col("ts"), 600, BLOCK).select("source", "line_no", "gap_us")


@query(f"""select source, line_no, '+' || case when us < 3600000000 then printf('%02d:%02d.%03d', us // 60000000, us // 1000000 % 60, us // 1000 % 1000) else printf('%dh%02dm', us // 3600000000, us // 60000000 % 60) end label from {_LAG} where us < 86400000000 and us >= 0""")
def q_relative(spark, d):
    r = records.since_previous(event_fields(spark, d), F.col("ts"), BLOCK)
    return r.filter("delta_us < 86400000000 and delta_us >= 0").select("source", "line_no", times.show_relative(F.col("delta_us")).alias("label"))


@query(f"""select source, coalesce(min(line_no) filter (line_no > 3), min(line_no)) next_line, coalesce(max(line_no) filter (line_no < 3), max(line_no)) previous_line, count(*) filter (line_no <= 3) "rank", count(*) total
from {_LINES} where contains(lower(raw), 'the') group by source""")
def q_next_prev(spark, d):
    return records.neighbours(document_lines(spark, d).filter(P.text(F.col("raw"), "the")), 3)


@query(f"select source, line_no, raw from (select *, max(line_no) over (partition by source) hi from {_LINES}) where line_no > hi - 3")
def q_tail(spark, d):
    return records.tail(document_lines(spark, d), 3).select("source", "line_no", "raw")


@query("""select 'app-' || u || '.' || kind source, format, round(trust::double, 6) score from (select distinct user_id % 4 u from events), (values ('logfmt', 'logfmt', 0.97), ('jsonl', 'json_lines', 1.0), ('csv', 'csv', 0.85), ('access', 'access_combined', 1.0),
('syslog_3164', 'syslog_3164', 1.0), ('syslog_5424', 'syslog_5424', 1.0), ('log4j', 'time_level_thread_logger:iso', 0.97)) v(kind, format, trust)""")
def q_detect(spark, d):
    parts = [event_lines(spark, d, k).withColumn("source", F.concat(F.col("source"), F.lit(f".{k}"))) for k in ("logfmt", "jsonl", "csv", "access", "syslog_3164", "syslog_5424", "log4j")]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return detect.detect_formats(lines, 1 << 40).filter("nth = 1").select("source", "format", F.round("score", 6).alias("score"))


@query("select distinct 'app-' || (user_id % 4) source, case user_id % 4 when 1 then 'one' else 'logfmt' end profile from events")
def q_route(spark, d):
    return detect.route(event_lines(spark, d, "logfmt"), [detect.Profile("any", glob="app-*"), detect.Profile("logfmt", content="level="), detect.Profile("one", glob="app-1", content="level=")], 1 << 30)


@query("""with recursive h as (select 'app-' || (user_id % 4) source, epoch_us(ts) us from events where event_type = 'error'),
n(source, us, suppressed) as (
  select source, min(us), 0::bigint from h group by source
  union all
  select source, case when held > 0 then us + 300000000 else upcoming end, held from (
    select n.source, n.us, (select count(*) from h where h.source = n.source and h.us < n.us + 300000000 and (h.us > n.us or (h.us = n.us and n.suppressed > 0))) held,
      (select min(us) from h where h.source = n.source and h.us >= n.us + 300000000) upcoming from n) where held > 0 or upcoming is not null)
select source, 'error' "rule", us, suppressed from n""")
def q_alert_limit(spark, d):
    e = event_fields(spark, d)
    hits = e.filter("event_type = 'error'").select("source", F.lit("error").alias("rule"), "ts")
    return rules.limit_alerts(hits, 300).select("source", "rule", F.unix_micros("ts").alias("us"), "suppressed")


@query(f"""select source, line_no, '{{"level":"' || lower(level) || '","user":' || user_id || ',"k":' || k || ',"none":null}}' line from {_EVENTS}""")
def q_export_json(spark, d):
    r = ingest.logfmt(event_lines(spark, d, "logfmt"), LOGFMT).withColumn("none", F.lit(None).cast("string"))
    return r.select("source", "line_no", sinks.json_line({"level": "level", "user": "number", "k": "json", "none": "text"}).alias("line"))


@query(f"select event_type, regexp_replace(printf('%.2f', min(value)), '\\.?0+$', '') || ' ms' lo, regexp_replace(printf('%.2f', max(value)), '\\.?0+$', '') || ' ms' hi from {_EVENTS} where value > 1 and value < 999 group by event_type")
def q_readable(spark, d):
    r = ingest.logfmt(event_lines(spark, d, "logfmt"), ("level", "dur", "msg")).withColumn("ns", kinds.duration_ns(F.col("dur"))).filter("ns > 1e6 and ns < 999e6")
    kind = F.regexp_extract("msg", '"(.*)"', 1).alias("event_type")
    return r.groupBy(kind).agg(kinds.show_duration(F.min("ns")).alias("lo"), kinds.show_duration(F.max("ns")).alias("hi"))


@query(f"select source, 'iso' format from {_EVENTS} group by source")
def q_learn_formats(spark, d):
    return times.learn_formats(event_lines(spark, d, "logfmt"), 1 << 40)


@query(f"select source, line_no, nth, \"name\", \"value\" from (select source, line_no, 0 nth, 'level' \"name\", lower(level) \"value\" from {_EVENTS} union all select source, line_no, 1, 'user', user_id::varchar from {_EVENTS})")
def q_key_value_rows(spark, d):
    r = ingest.logfmt(event_lines(spark, d, "logfmt"), ("level", "user")).filter("is_record")
    return stats.as_rows(r, ["level", "user"]).select("source", "line_no", "nth", "name", "value")


@query(f"select source, line_no, len(regexp_extract_all(raw, '[0-9]+')) n from {_LINES} where regexp_matches(raw, '[0-9]')")
def q_match_positions(spark, d):
    return stats.match_positions(document_lines(spark, d), "[0-9]+").groupBy("source", "line_no").agg(F.count("*").alias("n"))


def _short_lines(spark, d):
    """(source, line_no, raw) of events as short lines with a letter outside ASCII."""
    return spread(event_fields(spark, d)).select("source", "line_no", F.concat_ws(" ", F.lit("é"), "event_type", F.col("user_id").cast("string"), "k").alias("raw"))


_SHORT = f"(select source, row_number() over (partition by source order by line_no) - 1 line_no, 'é ' || event_type || ' ' || user_id || ' ' || k raw from {_EVENTS})"


@query(f"select source, line_no, (sum(strlen(raw) + 1) over (partition by source order by line_no) - strlen(raw) - 1)::bigint byte_off, strlen(raw)::int byte_len, raw from {_SHORT}")
def q_read_lines(spark, d):
    path = own_path(spark, "lines")
    _short_lines(spark, d).repartition("source").sortWithinPartitions("source", "line_no").select("source", "raw").write.partitionBy("source").option("lineSep", "\n").text(path)
    lines = materialize(sources.read_lines(spark, path, recursive=True), "numbered")
    return lines.withColumn("source", F.regexp_extract("source", "source=([^/]+)", 1))


@query(f"select e encoding, 'crlf' line_ending, count(*) n, count(distinct raw) n_distinct from {_SHORT}, (values ('UTF-8'), ('UTF-16LE'), ('ISO-8859-1')) v(e) group by e")
def q_encodings(spark, d):
    out = []
    for enc in ("UTF-8", "UTF-16LE", "ISO-8859-1"):
        path = own_path(spark, "encoded")
        _short_lines(spark, d).select(F.encode("raw", enc).cast("string").alias("raw")).write.option("lineSep", "\r\n").option("encoding", enc).text(path)
        kind = sources.encodings(spark, f"{path}/*.txt").select("encoding", "line_ending").distinct()  # the same for all files
        lines = sources.read_encoded(spark, f"{path}/*.txt", enc).agg(F.count("*").alias("n"), F.count_distinct("raw").alias("n_distinct"))
        out.append(kind.crossJoin(F.broadcast(lines)))  # one row each
    return reduce(DataFrame.unionByName, out)


@query(f"select source, line_no, k ab, user_id::varchar twice, '{{\"f\":' || k || '}}' deep, k extra_deep from {_EVENTS}")
def q_json_keys(spark, d):
    e = event_fields(spark, d)
    user = F.col("user_id").cast("string")
    raw = F.concat(F.lit('{"a.b":'), "k", F.lit(',"a":{"b":-1},"twice":'), user, F.lit(',"twice":0,"none":null,"x":{"y":{"z":{"e":{"f":'), "k", F.lit('}}}},"arr":[1,{"q":2}]}'))
    r = ingest.json_lines(e.select("source", "line_no", raw.alias("raw")), ("a.b", "twice", "x.y.z.e")).filter("is_record")
    return r.select("source", "line_no", F.col("`a.b`").alias("ab"), "twice", F.col("`x.y.z.e`").alias("deep"), F.get_json_object("`x.y.z.e`", "$.f").alias("extra_deep"))


@query("""select count(*) filter (lower(o_orderpriority) = '3-medium') same, count(*) filter (lower(o_orderpriority) >= '3') at_least, count(*) filter (o_totalprice > 100000) above, count(*) filter (abs(o_totalprice - 150000) <= 50000) near_, count(*) filter (regexp_matches(o_orderpriority, '^[12]-')) matched,
count(*) filter (not regexp_matches(o_orderpriority, '^[12]-')) unmatched, count(*) filter (o_totalprice >= 100) lenient, count(*) filter (o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01') in_year from orders""")
def q_predicates(spark, d):
    o = table(spark, d, "orders").withColumns({"price": F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("B")), "day": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")})
    p, price = F.col("o_orderpriority"), F.col("price")
    return o.agg(
        F.count_if(P.equals(p, "3-MEDIUM")).alias("same"), F.count_if(P.compare(p, ">=", "3")).alias("at_least"), F.count_if(P.compare(price, ">", "100kb", "bytes")).alias("above"),
        F.count_if(P.all_of(P.compare(price, ">=", "0.1MB", "bytes"), P.compare(price, "<=", "200000", "bytes"))).alias("near_"), F.count_if(P.matches(p, "^[12]-")).alias("matched"), F.count_if(P.not_(P.matches(p, "^[12]-"))).alias("unmatched"),
        F.count_if(P.rule_condition(price, "ge", "100")).alias("lenient"), F.count_if(P.equals(F.col("day"), "1995", "timestamp")).alias("in_year"),
    )


@query("select l_returnflag, count(*) n, round(sum(l_extendedprice * 1024), 1) size, round(sum(l_quantity * 1e9), 1) ns from lineitem where l_quantity = 17 or l_quantity = 25 group by 1")
def q_typed(spark, d):
    r = spread(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")).select("l_returnflag", F.concat(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(" KiB")).alias("size"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("s")).alias("took"))
    r = r.filter(P.one_of(F.col("took"), ["17000ms", "25s"], "duration"))
    return r.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(kinds.typed(F.col("size"), "bytes")), 1).alias("size"), F.round(F.sum(kinds.typed(F.col("took"), "duration")), 1).alias("ns"))


@query("""select event_id, case when epoch_us(ts) % 1000000 = 0 then strftime(ts + interval 2 hour, '%Y-%m-%d %H:%M:%S') when epoch_us(ts) % 1000 = 0 then left(strftime(ts + interval 2 hour, '%Y-%m-%d %H:%M:%S.%f'), 23)
else strftime(ts + interval 2 hour, '%Y-%m-%d %H:%M:%S.%f') end shown from (select event_id, case event_id % 3 when 0 then date_trunc('second', ts) when 1 then date_trunc('millisecond', ts) else ts end ts from events)""")
def q_in_zone(spark, d):
    ts = F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", "ts")).when(F.col("event_id") % 3 == 1, F.date_trunc("millisecond", "ts")).otherwise(F.col("ts"))
    return event_fields(spark, d).select("event_id", times.in_zone(ts, "+02:00").alias("shown"))


@query("select doc_id, lang, nullif(text, '') text from documents")
def q_csv_round_trip(spark, d):
    """Whole texts; a null comes back as it went, an empty text as null, as both are empty cells."""
    r = table(spark, d, "documents").select(F.lit(True).alias("is_record"), F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    path = own_path(spark, "csv")
    sinks.write_csv(r, path, ["doc_id", "lang", "text"])
    return sinks.read_csv(spark, path, "doc_id long, lang string, text string")


@query("select count(*) \"count\", min(value * 1e6) \"min\", max(value * 1e6) \"max\", round(avg(value * 1e6), 3) mean from events where event_type = 'error'")
def q_filtered_profile(spark, d):
    r = ingest.logfmt(event_lines(spark, d, "logfmt"), LOGFMT).filter("is_record")
    p = stats.profile(r, {"dur": "duration"}, where=P.equals(F.col("level"), "E", "level"))
    return p.select("count", "min", "max", F.round("mean", 3).alias("mean"))


@query("""with c as (select o_custkey::varchar "value", count(*) n from orders group by 1 order by n desc, "value" limit 50)
select "value", n "count", row_number() over (order by "value"::double) nth from c""")
def q_value_list(spark, d):
    v = stats.value_candidates(table(spark, d, "orders"), "o_custkey", 50)
    return records.ranked(v, kinds.number(F.col("value")).asc_nulls_last(), F.col("value"))


@query(f"select source, line_no, nth from (select source, line_no, event_type, row_number() over (order by eff nulls first, source, line_no) nth from (select source, line_no, event_type, max(case when event_id % 5 <> 0 then ts end) over (partition by source order by line_no) eff from {_EVENTS})) where event_type in ('error', 'purchase') and event_type <> 'purchase'")
def q_merged_filter(spark, d):
    e = event_fields(spark, d).select("source", "line_no", F.col("event_type").alias("raw"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("t"))
    m = records.ranked(records.effective_time(e, F.col("t"), BLOCK), F.col("eff_ts").asc_nulls_first(), F.col("source"), F.col("line_no"))
    keep, wrong = P.build_stack(F.col("raw"), [P.Row("^(error|purchase)$", "regex"), P.Row("purchase", exclude=True), P.Row("(", "regex"), P.Row("", exclude=True), P.Row("nothing", enabled=False)])
    assert list(wrong) == [2]
    return m.filter(keep).select("source", "line_no", "nth")


@query(f"select source, line_no, level, user_id::varchar \"user\", case when user_id % 4 = 2 then k end k from {_EVENTS}")
def q_headers(spark, d):
    """Sources whose columns come in different orders, one with a third column, as their header lines say."""
    e = event_fields(spark, d)
    user, kind = F.col("user_id").cast("string"), F.col("user_id") % 4
    cells = lambda *by: F.when(kind == 0, F.concat_ws(";", *by[0])).when(kind == 1, F.concat_ws(";", *by[1])).when(kind == 2, F.concat_ws(";", *by[2])).otherwise(F.concat_ws(";", *by[3]))
    quoted = F.concat(F.lit('"'), "level", F.lit('"'))
    rows = e.select("source", (F.col("line_no") + 1).alias("line_no"), cells(("level", user), (user, quoted), ("k", quoted, user), (user, "level")).alias("raw"))
    name = lambda *names: [F.lit(n) for n in names]
    heads = e.select("source", F.lit(0).cast("long").alias("line_no"), cells(name("level", '"user"'), name("user", '"level"'), name("k", "level", " user "), name("user", "level")).alias("raw")).distinct()
    r = ingest.headed(rows.unionByName(heads), ";").filter("is_record")
    return r.select("source", (F.col("line_no") - 1).alias("line_no"), F.col("fields.level").alias("level"), F.col("fields.user").alias("user"), F.col("fields.k").alias("k"))


@query("select 'app-' || (user_id % 4) source, case when user_id % 4 = 3 then 'json' else 'logfmt' end definition from events group by all")
def q_best_definition(spark, d):
    lines = event_lines(spark, d, "logfmt").filter("source <> 'app-3'").unionByName(event_lines(spark, d, "jsonl").filter("source = 'app-3'"))
    raw = F.col("raw")
    return ingest.best_definition(lines, {"logfmt": ingest.is_logfmt(raw), "json": raw.startswith("{") & F.try_parse_json(raw).isNotNull(), "again": ingest.is_logfmt(raw)}, 1 << 40)


@query(f"select source, line_no, epoch_us(case event_id % 3 when 0 then ts else date_trunc('second', ts) end) us from {_EVENTS}")
def q_record_time(spark, d):
    """The time column holds a time in two of three records, in two formats; the third has it in its line only."""
    e = event_fields(spark, d)
    apache = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z")
    cell = F.when(F.col("event_id") % 3 == 0, F.col("iso")).when(F.col("event_id") % 3 == 1, apache).otherwise("n/a")
    raw = F.concat(F.lit("x ["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "event_type")
    return e.select("source", "line_no", F.unix_micros(times.record_time(cell, raw)).alias("us"))


@query(f"""with t as (select source, min(ts) lo, max(ts) hi, max(line_no) n from {_EVENTS} group by 1)
select source, min(line_no) filter (ts >= hi - interval 15 minute) back, min(line_no) filter (ts >= lo + interval 90 minute) ahead, any_value(least(floor(0.5 * (n + 1))::bigint, n)) half, any_value(least(n, 119)) line_ from {_EVENTS} join t using (source) group by source""")
def q_go_to(spark, d):
    e = event_fields(spark, d)
    go = lambda text, name: records.go_to_time(e, F.col("ts"), text, "2024-01-05 00:00:00").withColumnRenamed("line_no", name)
    return go("-15m", "back").join(go("+1h30m", "ahead"), "source").join(records.go_to(e, "50%").withColumnRenamed("line_no", "half"), "source").join(records.go_to(e, "120").withColumnRenamed("line_no", "line_"), "source")


@query(f"""with l as {_ALL}, k as (select source, line_no, level_rank, max(case when o = 0 then line_no end) over (partition by source order by line_no) rec from l),
v as (select source, line_no rec, value from {_EVENTS})
select k.source, k.line_no, row_number() over (order by v.value desc, k.source, rec, k.line_no) nth from k join v using (source, rec)""")
def q_sorted_records(spark, d):
    lines = ingest.logfmt(with_continuations(event_lines(spark, d, "logfmt")), LOGFMT)
    lines = records.with_record(lines, F.col("is_record"), BLOCK)
    keys = lines.filter("rec_id = line_no").select("source", "rec_id", records.sort_key(F.col("dur"), "duration").alias("key"))
    return records.ranked(lines.join(keys, ["source", "rec_id"]), F.col("key").desc_nulls_last(), F.col("source"), F.col("rec_id"), F.col("line_no")).select("source", "line_no", "nth")


@query(f"select source, line_no, raw from {_LINES} where contains(lower(raw), 'the') order by source, line_no limit 25")
def q_first_matches(spark, d):
    hits, more = records.first_matches(document_lines(spark, d), P.text(F.col("raw"), "the"), 25)
    assert more in (True, False)
    return hits.select("source", "line_no", "raw")


@query("select 'l_quantity' \"name\", count(*) \"count\", 0::bigint missing, count(*) numeric_count, min(l_quantity)::double \"min\", max(l_quantity)::double \"max\", round(avg(l_quantity), 6) mean, 50::bigint distinct_estimate from lineitem")
def q_merged_profiles(spark, d):
    """States of three parts of the table, merged."""
    r = table(spark, d, "lineitem").select("l_quantity", "l_returnflag")
    states = [stats.profile_state(r.filter(p), {"l_quantity": "number"}) for p in ("l_returnflag = 'A'", "l_returnflag = 'N'", "l_returnflag not in ('A', 'N')")]
    out = stats.profile_of(stats.merged_states(reduce(DataFrame.unionByName, states)))
    return out.select("name", "count", "missing", "numeric_count", "min", "max", F.round("mean", 6).alias("mean"), "distinct_estimate")


@query("select ((nth - 1) * 20 // n)::int bin, count(*) n from (select l_returnflag, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) nth, count(*) over () n from lineitem) where l_returnflag = 'R' group by 1")
def q_position_density(spark, d):
    r = spread(table(spark, d, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_returnflag"))
    order = records.ranked(r, F.col("l_extendedprice").desc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber"))
    return stats.position_density(order, F.col("l_returnflag") == "R", 20)


@query(f"select source, line_no, '{{\"level\":\"' || lower(level) || '\",\"user\":' || user_id || ',\"ts\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '\",\"k\":' || k || '}}' line from {_EVENTS}")
def q_record_json(spark, d):
    e = event_fields(spark, d)
    raw = F.concat(F.lit("level="), F.lower("level"), F.lit(" ts="), "iso", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" k="), "k")
    r = ingest.logfmt(e.select("source", "line_no", raw.alias("raw")), ("level", "user")).filter("is_record")
    return r.select("source", "line_no", sinks.record_json({"level": "level", "user": "number"}).alias("line"))


@query(f"select source, line_no, user_id % 10 = 0 manual from {_EVENTS} where user_id % 10 = 0 or event_type = 'error'")
def q_bookmarks(spark, d):
    e = event_fields(spark, d)
    manual = e.filter("user_id % 10 = 0").select("source", "line_no", F.lit(False).alias("automatic"))
    new = sinks.new_bookmarks(e.filter("event_type = 'error'"), manual)
    return manual.unionByName(new).select("source", "line_no", (~F.col("automatic")).alias("manual"))


SLICES = 4


#: Numbers in a slice for which it has a file more.
FILE_ROWS = 250_000


def _event_files(spark, d) -> tuple[str, int]:
    """Events as lines in files, one slice of the numbers after the other, so that a stream of one slice a batch sees each source in order; and the number of files of a slice, the same for all."""
    e = table(spark, d, "events")
    path = own_path(spark, "event-lines")
    last = e.agg(F.max("event_id")).first()[0] or 0
    at = F.floor(F.col("line_no") / 4 * SLICES / (last + 1))
    numbered = e.withColumn("line_no", F.col("event_id") * 4)
    sizes = {r["i"]: r["n"] for r in numbered.groupBy(at.alias("i")).agg(F.approx_count_distinct("line_no").alias("n")).collect()}  # a row for each slice
    # So many numbers for a file that none is left out as empty.
    files = max(1, min(spark.sparkContext.defaultParallelism, *[sizes.get(i, 0) // FILE_ROWS for i in range(SLICES)]))
    for i in range(SLICES):
        near = F.col("event_id").between(i * (last + 1) // SLICES - 1, (i + 1) * (last + 1) // SLICES + 1)  # lets the scan leave out what is far off
        part = numbered.filter(near).filter(at == i).select(F.concat(F.lit("app-"), (F.col("user_id") % 4).cast("string")).alias("source"), "line_no", F.col("event_type").alias("raw"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user"), "value")
        (part.repartition(files, "line_no") if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return path, files


def _event_stream(spark, d):
    path, files = _event_files(spark, d)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def _ended(spark, stream):
    """The rows that a stream writes over what is there now, batch by batch, to files in the shared folder."""
    path = own_path(spark, "stream-out")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _last(spark, stream):
    """The last state of a stream of aggregates: each batch writes the whole of it, which has a row for each group, to a folder of its own."""
    path, batches = own_path(spark, "stream-out"), []

    def keep(batch, k):
        batch.write.mode("overwrite").parquet(f"{path}/{k}")
        batches.append(k)

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{max(batches)}")


@query(f"select source, line_no, event_type raw from {_EVENTS} where contains(event_type, 'err')")
def q_stream_filter(spark, d):
    return _ended(spark, live.live_filter(_event_stream(spark, d), P.text(F.col("raw"), "err"))).select("source", "line_no", "raw")


@query(f"select source, count(*) n from {_EVENTS} where contains(event_type, 'err') group by 1")
def q_stream_counts(spark, d):
    return _last(spark, live.live_counts(_event_stream(spark, d), P.text(F.col("raw"), "err")))


_STREAMED = " union all ".join(f"select '{n}' \"name\", count({c}) \"count\", 0::bigint missing, count({v}) numeric_count, min({v}) \"min\", max({v}) \"max\", round(avg({v}), 6) mean from events" for n, c, v in (("raw", "event_type", "null::double"), ("user", "user_id", "user_id::double"), ("value", "value", "value")))


@query(f"select * from ({_STREAMED})")
def q_stream_profile(spark, d):
    """All columns of a stream of several batches, by states that merge."""
    view = views.ProfileView(own_path(spark, "profile-view"), {"raw": "text", "user": "number", "value": "number"})
    live.deliver(_event_stream(spark, d), view).option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return view.profile(spark).select("name", "count", "missing", "numeric_count", "min", "max", F.round("mean", 6).alias("mean"))


_FREQUENT = """(select 'event_type' "name", event_type "value", count(*) n from events group by 2 union all select 'user', (user_id % 40)::varchar, count(*) from events group by 2)"""


@query(f"""select "name", "value", n at_least, n at_most, row_number() over (partition by "name" order by n desc, "value") nth from {_FREQUENT} qualify nth <= 10""")
def q_stream_frequent(spark, d):
    s = _event_stream(spark, d).select(F.col("raw").alias("event_type"), (F.col("user").cast("long") % 40).cast("string").alias("user"))
    view = views.ProfileView(own_path(spark, "profile-view"), {"event_type": "text", "user": "text"})
    live.deliver(s, view).option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return view.frequent(spark).withColumn("nth", F.col("nth").cast("long"))


@query("""with w as (select unnest(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')) word, lang from documents), c as (
  select 'word' "name", word "value", count(*) "count" from w where word <> '' group by 2 union all select 'lang', lang, count(*) from w where word <> '' and lang <> '' group by 2
  union all select 'length', length(word)::varchar, count(*) from w where word <> '' group by 2)
select *, row_number() over (partition by "name" order by "count" desc, "value") nth from c where "value" is not null qualify nth <= 8""")
def q_frequent_values(spark, d):
    """The first words, languages and word lengths of the corpus, by candidates from bounded states."""
    words = spread(table(spark, d, "documents").select("text", "lang")).select("lang", F.explode(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).alias("word"))
    return stats.frequent_values(words.withColumn("length", F.length("word")), {"word": "text", "lang": "text", "length": "text"}, 8)


@query(f"select source, line_no, user_id % 10 <> 0 automatic from {_EVENTS} where user_id % 10 = 0 or event_type in ('error', 'purchase')")
def q_stream_bookmarks(spark, d):
    """Manual bookmarks and those of two streams, some of the same lines."""
    path = own_path(spark, "bookmarks")
    views.add_manual(event_fields(spark, d).filter("user_id % 10 = 0"), path)
    for name, kinds_of in (("errors", ["error"]), ("money", ["purchase", "error"])):
        hits = _event_stream(spark, d).filter(F.col("raw").isin(kinds_of))
        live.deliver(hits, views.BookmarkView(path, name)).option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return views.bookmarks(spark, path)


@query(f"select source, line_no, epoch_us(max(ts) over (partition by source order by line_no)) eff_us from {_EVENTS}")
def q_stream_effective_time(spark, d):
    s = _event_stream(spark, d)
    return _ended(spark, live.live_effective_time(s, F.col("ts"))).select("source", "line_no", "eff_us")


@query(f"""with l as (select source, line_no, event_type raw, row_number() over (partition by source order by line_no) i, event_type = 'error' hit from {_EVENTS})
select a.source, a.line_no, a.raw, not a.hit is_context from l a where a.hit or exists (select 1 from l b where b.source = a.source and b.hit and (b.i between a.i + 1 and a.i + 2 or b.i = a.i - 1))""")
def q_stream_context(spark, d):
    return _ended(spark, live.live_context(_event_stream(spark, d), P.text(F.col("raw"), "error"), 2, 1)).select("source", "line_no", "raw", "is_context")


@query(f"select source, line_no, epoch_us(eff) us, row_number() over (order by eff nulls first, source, line_no) nth, false late from {_MERGE}")
def q_stream_merge(spark, d):
    """The merged view of a stream of several batches, then what still waits."""
    stream = _event_stream(spark, d).withColumn("t", F.when(F.col("line_no") / 4 % 5 != 0, F.col("ts")))
    view = merged.MergedView(own_path(spark, "merged-view"), idle_ms=1 << 40)
    live.deliver(live.live_effective_time(stream, F.col("t")), view).option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    view.finish(spark)
    return view.rows(spark).select("source", "line_no", F.col("eff_us").alias("us"), "nth", "late")


@query(f"""with l as {_LINES}, m as (select *, contains(lower(raw), 'the') a, regexp_matches(raw, '[0-9]') b from l)
select source, count(*) filter (a and b) both_, count(*) filter (a or b) either, count(*) filter (a and not b) only_first, count(*) filter (not a) outside, count(*) filter (a and line_no <= 3) rank3, count(*) filter (a) total,
coalesce(sum(line_no) filter (a and b), 0)::bigint sum_both, coalesce(sum(line_no) filter (not a), 0)::bigint sum_outside from m group by source having count(*) filter (a or b) > 0""")
def q_match_sets(spark, d):
    lines = document_lines(spark, d)
    a, b = (matchsets.match_set(lines.filter(p).select("source", "line_no")) for p in (P.text(F.col("raw"), "the"), P.regex(F.col("raw"), "[0-9]")))
    a, b = materialize(a, "match-set"), materialize(b, "match-set")
    n = lambda m, name: matchsets.counts(m).withColumnRenamed("n", name)
    out = n(matchsets.combined(a, b, "or"), "either")
    inside = matchsets.restricted(matchsets.restricted(lines, a), b).groupBy("source").agg(F.sum("line_no").alias("sum_both"))
    outside = matchsets.excluded(lines, a).groupBy("source").agg(F.count("*").alias("outside"), F.sum("line_no").alias("sum_outside"))
    at = matchsets.ranks(out.select("source", F.lit(3).cast("long").alias("line_no")), a).select("source", F.col("rank").alias("rank3"), "total")
    for more in (n(matchsets.combined(a, b, "and"), "both_"), n(matchsets.combined(a, b, "minus"), "only_first"), inside, outside, at):
        out = out.join(more, "source", "left")
    return out.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("both_", "either", "only_first", "outside", "rank3", "total", "sum_both", "sum_outside")])


_WIDE = "(select source, row_number() over (partition by source order by line_no) - 1 line_no, 'Ċ਀ഊ' || event_type || ' ' || user_id || case when user_id % 3 = 0 then '' else '✓' || k end raw from " + _EVENTS + ")"


@query(f"select e encoding, source, line_no, raw from {_WIDE}, (values ('UTF-16LE'), ('UTF-16BE'), ('UTF-32BE')) v(e)")
def q_encoded_lines(spark, d):
    """Lines in wide encodings, with letters whose code units hold the bytes of line ends."""
    raw = F.concat(F.lit("Ċ਀ഊ"), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("✓"), "k")))
    lines = materialize(spread(event_fields(spark, d)).select("source", "line_no", raw.alias("raw")), "wide-lines")
    out = []
    for enc in ("UTF-16LE", "UTF-16BE", "UTF-32BE"):
        path = own_path(spark, "encoded")
        data = F.encode("raw", "UTF-32" if enc == "UTF-32BE" else enc).cast("string").alias("raw")
        lines.repartition("source").sortWithinPartitions("source", "line_no").select("source", data).write.partitionBy("source").option("lineSep", "\n").option("encoding", enc).text(path)
        got = sources.read_encoded(spark, f"{path}/*/*.txt", enc)
        out.append(got.select(F.lit(enc).alias("encoding"), F.regexp_extract("source", "source=([^/]+)", 1).alias("source"), "line_no", "raw"))
    return reduce(DataFrame.unionByName, out)


#: Entities planted in lines made from events: name -> (text before, the value in Spark, text behind, the value in SQL).
_PLANTED = {
    "ipv4": ("from ", "concat('10.', user_id % 256, '.0.', event_id % 256, ':80')", " ok", "'10.' || (user_id % 256) || '.0.' || (event_id % 256) || ':80'"),
    "ipv6": ("from ", "concat('fe80::', lower(hex(event_id)), ':', lower(hex(user_id)))", " ok", "'fe80::' || printf('%x', event_id) || ':' || printf('%x', user_id)"),
    "uuid": ("id ", "format_string('%08x-0000-4000-8000-%012x', event_id, user_id)", ";", "printf('%08x-0000-4000-8000-%012x', event_id, user_id)"),
    "timestamp": ("[", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")", "] v1.2", "left(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 23) || 'Z'"),
    "url": ("see <", "concat('https://host/', event_type, '?id=', event_id)", ">", "'https://host/' || event_type || '?id=' || event_id"),
    "path": ("in ", "concat('/var/log/', event_type, '/', event_id, '.log')", ", gone", "'/var/log/' || event_type || '/' || event_id || '.log'"),
    "level": ("- ", "level", " -", "level"),
    "http_method": ('"', "element_at(array('GET', 'POST', 'DELETE'), cast(event_id % 3 + 1 as int))", ' /x HTTP/1.1"', "case event_id % 3 when 0 then 'GET' when 1 then 'POST' else 'DELETE' end"),
    "http_status": ('"GET / HTTP/1.1" ', "cast(200 + user_id % 300 as string)", " 77", "(200 + user_id % 300)::varchar"),
    "number": ("took ", "format_string('%.2f', value)", "ms v2x", "printf('%.2f', value)"),
    "exception": ("threw ", "concat('app.svc.', initcap(event_type), 'Error')", ": oops", "'app.svc.' || upper(left(event_type, 1)) || substr(event_type, 2) || 'Error'"),
    "stack_frame": ("", "concat('\tat app.Svc$Inner.', event_type, '(Svc.java:', event_id, ')')", "", "chr(9) || 'at app.Svc$Inner.' || event_type || '(Svc.java:' || event_id || ')'"),
}


@query(" union all ".join(f"select source, event_id * 12 + {i} line_no, '{n}' entity, {sql} \"value\" from {_EVENTS}" for i, (n, (_, _, _, sql)) in enumerate(_PLANTED.items())))
def q_entities(spark, d):
    """Each line holds one value of one entity; the values of that entity are found in it, and no others."""
    e = spread(event_fields(spark, d))
    at = [F.struct((F.col("event_id") * 12 + i).alias("line_no"), F.concat(F.lit(a), F.expr(v), F.lit(b)).alias("raw")) for i, (a, v, b, _) in enumerate(_PLANTED.values())]
    lines = e.select("source", F.explode(F.array(*at)).alias("x")).select("source", "x.*")
    planted = F.get(F.array(*[F.lit(n) for n in _PLANTED]), (F.col("line_no") % 12).cast("int"))
    return rules.entities(lines).filter(F.col("entity") == planted)


#: Times as text lines begin with them, in Spark, by the family that detection tells them apart by.
_STAMPED = {
    "iso": "date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')", "slashed": "date_format(ts, 'yyyy/MM/dd HH:mm:ss')", "compact": "date_format(ts, \"yyyyMMdd'T'HHmmss\")", "apache": "concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000')",
    "rfc2822": "concat(date_format(ts, 'EEE, d MMM yyyy HH:mm:ss'), ' +0000')", "us": "date_format(ts, 'M/d/yyyy, h:mm:ss a')", "syslog": "concat(date_format(ts, 'MMM '), lpad(dayofmonth(ts), 2, ' '), date_format(ts, ' HH:mm:ss'))", "clock": "date_format(ts, 'HH:mm:ss.SSS')",
    "epoch": "cast(unix_millis(ts) as string)", "day_first": "date_format(ts, 'dd.MM.yyyy HH:mm:ss')",
}
_LAID = {
    "time_level_message": "concat('[', t, '] ', level, ' - event ', event_id)", "time_level_thread_message": "concat(t, ' ', level, ' [worker-', user_id, '] event ', event_id)", "time_level_thread_logger": "concat(t, ' ', level, ' [worker-', user_id, '] app.Svc: event ', event_id)",
    "time_thread_level_logger": "concat(t, ' [worker-', user_id, '] ', level, ' app.Svc - event ', event_id)", "level_time_message": "concat(level, ' ', t, ' event ', event_id)", "time_message": "concat(t, ' event ', event_id)",
}
_SEPARATED = {"tsv": "\t", "psv": "|", "ssv": ";"}


@query(" union all ".join(f"select '{n}:{f}' source, '{n}:{f}' format, {t}::double score" for f in _STAMPED for n, (_, _, t) in detect.LAYOUTS.items()) + "".join(f" union all select '{n}', '{n}', {t}::double" for n, t in (*((n, 0.85) for n in _SEPARATED), ("access_common", 1.0), ("w3c", 1.0))))
def q_detect_layouts(spark, d):
    """A source for each layout of text lines and each family of times, for each other separator, and for the formats that q_detect has not. Lines may fit other formats as well; each source has its own among them."""
    # In two steps, each short enough for the JVM to compile: an event's times, then the lines of each; the others with none.
    stamps = F.array(*[F.struct(F.lit(f).alias("family"), F.expr(t).alias("t")) for f, t in _STAMPED.items()], F.struct(F.lit(None).cast("string").alias("family"), F.lit("").alias("t")))
    dealt = event_fields(spark, d).repartition(4 * spark.sparkContext.defaultParallelism)  # an event becomes 65 lines, so all cores get some whatever splits the events are read in
    e = dealt.select("event_id", "user_id", "event_type", "level", "ts", F.inline(stamps))
    laid = [F.struct(F.concat(F.lit(f"{n}:"), "family").alias("source"), F.expr(raw).alias("raw")) for n, raw in _LAID.items()]
    others = [F.struct(F.lit(n).alias("source"), F.concat_ws(sep, "event_type", "level", F.col("user_id").cast("string")).alias("raw")) for n, sep in _SEPARATED.items()]
    others.append(F.struct(F.lit("access_common").alias("source"), F.expr("concat('10.0.0.1 - u', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, '\" 200 ', event_id)").alias("raw")))
    others.append(F.struct(F.lit("w3c").alias("source"), F.expr("if(event_id = 0, '#Fields: date sc-status user', concat(date_format(ts, 'yyyy-MM-dd'), ' 200 ', user_id))").alias("raw")))
    rows = e.select(F.col("event_id").alias("line_no"), F.inline(F.when(F.col("family").isNull(), F.array(*others)).otherwise(F.array(*laid)))).select("source", "line_no", "raw")
    return detect.detect_formats(rows, 1 << 40).filter("source = format").select("source", "format", F.round("score", 6).alias("score"))


_STARTS = f"(select source, line_no, max(case when event_type = 'error' then line_no end) over (partition by source order by line_no) rec_id from {_EVENTS})"


@query(f"select source, rec_id, count(*) n_lines from {_STARTS} where rec_id is not null group by 1, 2 qualify rec_id < max(rec_id) over (partition by source)")
def q_stream_records(spark, d):
    """Records of a stream that go over its batches; each source's last one is still open."""
    return _ended(spark, live.live_records(_event_stream(spark, d), P.text(F.col("raw"), "error"), idle_ms=None)).select("source", "rec_id", "n_lines")


@query("""with recursive h as (select 'app-' || (user_id % 4) source, event_id * 60000000 us from events where event_type = 'error'),
n(source, us, suppressed) as (
  select source, min(us), 0::bigint from h group by source
  union all
  select source, case when held > 0 then us + 3600000000 else upcoming end, held from (
    select n.source, n.us, (select count(*) from h where h.source = n.source and h.us < n.us + 3600000000 and (h.us > n.us or (h.us = n.us and n.suppressed > 0))) held,
      (select min(us) from h where h.source = n.source and h.us >= n.us + 3600000000) upcoming from n) where held > 0 or upcoming is not null)
select source, us, suppressed from n where suppressed = 0 or us <= (select max(us) from h where h.source = n.source)""")
def q_stream_alerts(spark, d):
    """Alerts of a stream over its batches, one event a minute; summaries that are due later than the last hit are still held."""
    s = _event_stream(spark, d).filter(P.text(F.col("raw"), "error")).select("source", F.lit("error").alias("rule"), F.timestamp_micros((F.col("line_no") / 4 * 60_000_000).cast("long")).alias("ts"), "raw")
    return _ended(spark, live.live_alerts(s, 3600, timers=False)).select("source", "us", "suppressed")


@query(f"select source, line_no, (sum(strlen(raw) + 1) over (partition by source order by line_no) - strlen(raw) - 1)::bigint byte_off, raw from {_SHORT}")
def q_growing_lines(spark, d):
    """Files of a folder as a stream of several batches and many ranges, numbered by executors. The shared folder must be a mounted one here."""
    lines, made = own_path(spark, "growing"), own_path(spark, "growing-files")
    _short_lines(spark, d).repartition("source").sortWithinPartitions("source", "line_no").select("source", "raw").write.partitionBy("source").option("lineSep", "\n").text(made)
    folder = lines.removeprefix("file://")
    if "://" in folder:
        raise RuntimeError(f"{folder} is not a mounted folder")
    for row in spark.read.text(made, recursiveFileLookup=True).select(F.input_file_name().alias("f")).distinct().collect():  # a file for each source
        os.makedirs(folder, exist_ok=True)
        shutil.copyfile(row["f"].removeprefix("file://"), f"{folder}/{re.search('source=([^/]+)', row['f'])[1]}.log")
    out = own_path(spark, "stream-out")
    stream = live.growing_lines(spark, folder, f"{own_path(spark, 'progress').removeprefix('file://')}", span=1 << 12, batch=1 << 16, most=64 << 20)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", own_path(spark, "stream")).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(stream.schema).parquet(out).select(F.regexp_extract("source", "([^/]+)[.]log$", 1).alias("source"), "line_no", "byte_off", "raw")


@query(f"select source, line_no, event_type || ' ' || level shown from {_EVENTS}")
def q_strip_ansi(spark, d):
    """Colours, a title with its terminator, a cursor move, and an escape that the line's end cuts off."""
    raw = F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m\x1b]0;title\x07 "), "level", F.lit("\x1b[2K\x1b["))
    return event_fields(spark, d).select("source", "line_no", kinds.strip_ansi(raw).alias("shown"))


@query(f"select source, line_no, lower(level) severity, user_id::varchar \"user\", k from {_EVENTS}")
def q_columns(spark, d):
    """Columns found by an alias and another case, in the order asked for."""
    r = ingest.logfmt(event_lines(spark, d, "logfmt"), LOGFMT).filter("is_record")
    names = kinds.ordered_columns(["k", "USER", "level"], ["severity", "user", "*"])
    found = [kinds.find_column(LOGFMT, n) for n in names]
    return r.select("source", "line_no", F.col(found[0]).alias("severity"), *found[1:])


_TRACED = f"(select count(*) * 3 from {_EVENTS} where event_type = 'error' and event_id % 7 = 0)"


@query(f"""select 'level' "name", count(*) records, {_TRACED} skipped, count(*) "count", 0::bigint missing, 0::bigint numeric_count, null::double "min", null::double "max", count(distinct level) distinct_estimate from {_EVENTS}
union all select 'dur', count(*), {_TRACED}, count(*), 0, count(*), round(min(value) * 1e6, 3), round(max(value) * 1e6, 3), null from {_EVENTS}""")
def q_merged_records(spark, d):
    """States of the records of each source, merged; lines that are no records are counted as skipped."""
    r = ingest.logfmt(with_continuations(event_lines(spark, d, "logfmt")), LOGFMT)
    states = [stats.profile_state(r.filter(F.col("source") == f"app-{i}"), {"level": "level", "dur": "duration"}) for i in range(4)]
    out = stats.profile_of(stats.merged_states(reduce(DataFrame.unionByName, states)))
    few = F.when(F.col("name") == "level", F.col("distinct_estimate")).alias("distinct_estimate")  # few values are counted exactly
    return out.select("name", "records", "skipped", "count", "missing", "numeric_count", F.round("min", 3).alias("min"), F.round("max", 3).alias("max"), few)


@query(" union all ".join(f"select '{m}' mode, source, line_no rec_id, case when event_type = 'error' and event_id % 7 = 0 then 4 else 1 end n_lines from {_EVENTS}" for m in ("pattern", "time")))
def q_record_starts(spark, d):
    """Records whose starts are told by a pattern, and by a time that begins the line."""
    lines = with_continuations(event_lines(spark, d, "log4j"))
    starts = {"pattern": records.record_start(F.col("raw"), pattern=r"^\d{4}-.*worker"), "time": records.record_start(F.col("raw"))}
    out = [records.bodies(records.with_record(lines, start, BLOCK)).select(F.lit(mode).alias("mode"), "source", "rec_id", "n_lines") for mode, start in starts.items()]
    return reduce(DataFrame.unionByName, out)


@query(f"select source, line_no, event_id % 500 <> 0 is_record, case when event_id % 500 <> 0 then lower(level) end \"level\" from {_EVENTS}")
def q_long_lines(spark, d):
    """Lines over 1 MiB are kept, but not parsed."""
    long = F.when(F.col("line_no") / 4 % 500 == 0, F.repeat(F.lit("x"), F.lit(1 << 20))).otherwise("")
    lines = event_lines(spark, d, "logfmt").withColumn("raw", F.concat("raw", F.lit(" pad="), long))
    return ingest.logfmt(lines, LOGFMT).select("source", "line_no", "is_record", "level")


@query(f"select source, line_no, epoch_us(ts) us, level_rank rank, user_id::varchar \"user\", k user_2, event_type col5, round(value * 1e6, 3) ns, user_id * 1024.0::double bytes from {_EVENTS}")
def q_named_schema(spark, d):
    """Columns from a header with a repeated and an empty name, typed by the kinds that their names suggest."""
    e = spread(event_fields(spark, d))
    raw = F.concat_ws(",", "iso", "level", "user_id", "k", "event_type", F.concat("dur", F.lit("ms")), F.concat(F.col("user_id").cast("string"), F.lit("KiB")))
    schema = kinds.schema_of(["time", "level", "user", "user", "", "took", "size"])
    r = ingest.delimited(e.select("source", "line_no", raw.alias("raw")), schema.names).filter("is_record")
    t = {f.name: kinds.typed(F.col(f.name), f.metadata["kind"]) for f in schema}
    return r.select("source", "line_no", F.unix_micros(t["time"]).alias("us"), t["level"].alias("rank"), t["user"].alias("user"), t["user_2"].alias("user_2"), t["col5"].alias("col5"), F.round(t["took"], 3).alias("ns"), t["size"].alias("bytes"))


@query("""with c as (select user_id::varchar "value", count(*) "count" from events group by 1 union all select 'nobody', 0)
select * from c order by "value" in ('7', 'nobody') desc, "count" desc, "value" limit 20""")
def q_selected_values(spark, d):
    """The values that are selected already come first among those to pick from, also if none is left of them."""
    return stats.value_candidates(event_fields(spark, d).select(F.col("user_id").cast("string").alias("user")), "user", 20, selected=["7", "nobody"])


_CONDITIONS = {"gt": ("250", "value > 250"), "ge": ("250", "value >= 250"), "lt": ("99.5", "value < 99.5"), "le": ("99.5", "value <= 99.5"), "eq": ("250.00ms", "c = '250.00ms'"), "ne": ("250.00ms", "c <> '250.00ms'"), "contains": ("9.5", "contains(c, '9.5')"), "regex": ("^1.*5ms$", "regexp_matches(c, '^1.*5ms$')")}


@query("with e as (select *, printf('%.2fms', value) c from events), n as (" + " union all ".join(f"select '{op}' rule, count(*) n, null::varchar problem from e where {sql}" for op, (_, sql) in _CONDITIONS.items()) + """ union all select 'same_number', count(*), null from e where user_id = 7)
select * from n where n > 0 union all select 'no_number', null, 'could not convert string to float: ''many''' union all select 'no_column', null, 'no_column: no column' union all select 'no_group', null, 'no_group: no group 2; the pattern has 1' union all select 'no_text', null, 'no_text: empty literal'""")
def q_rule_conditions(spark, d):
    """Rules on columns by all operators, and the rules that cannot be applied with what is wrong with them."""
    asked = [rules.Rule(op, value, "column", column="dur", op=op) for op, (value, _) in _CONDITIONS.items()]
    asked += [rules.Rule("same_number", "7.0", "column", column="user"), rules.Rule("missing", "x", "column", column="nowhere", op="ne"), rules.Rule("no_text", ""), rules.Rule("no_column", "x", "column"), rules.Rule("no_number", "many", "column", column="dur", op="gt"), rules.Rule("no_group", "(a)", "regex", group=2), rules.Rule("off", "", enabled=False)]
    good, wrong = rules.usable(asked)
    lines = event_fields(spark, d).select("source", "line_no", F.lit("").alias("raw"), F.concat("dur", F.lit("ms")).alias("dur"), F.col("user_id").cast("string").alias("user"))
    hits = rules.rule_hits(rules.tag_lines(lines, good, ["dur", "user"])).select("rule", "n", F.lit(None).cast("string").alias("problem"))
    return hits.unionByName(spark.createDataFrame([(r, None, why) for r, why in wrong.items()], "rule string, n long, problem string"))


@query(f"select source, line_no, row_number() over (order by date_trunc('minute', ts) desc nulls last, source, line_no) nth from {_EVENTS}")
def q_own_times(spark, d):
    """A sort by times that only a reader of the caller's can read."""
    e = event_fields(spark, d).select("source", "line_no", F.date_format("ts", "mm'~'HH dd|MM|yyyy").alias("cell"))
    key = records.sort_key(F.col("cell"), "timestamp", ts=lambda c: F.to_timestamp(c, "mm'~'HH dd|MM|yyyy"))
    return records.ranked(e, key.desc_nulls_last(), F.col("source"), F.col("line_no")).select("source", "line_no", "nth")


_KEYS = {"number": ("value", "dur"), "bytes": ("user_id", "concat(cast(user_id as string), ' KiB')"), "level": ("level_rank", "level"), "text": ("lower(event_type || ' ' || event_id)", "concat(upper(event_type), ' ', event_id)")}


@query(" union all ".join(f"select '{k}' kind, source, line_no, row_number() over (order by {sql} desc, source, line_no) nth from {_EVENTS}" for k, (sql, _) in _KEYS.items()))
def q_sort_keys(spark, d):
    """Whole sorts by cells of each kind."""
    e = event_fields(spark, d).withColumn("event_id", F.col("event_id").cast("string"))
    out = [records.ranked(e.select("source", "line_no", F.expr(cell).alias("cell")).withColumn("key", records.sort_key(F.col("cell"), k)), F.col("key").desc_nulls_last(), F.col("source"), F.col("line_no")).select(F.lit(k).alias("kind"), "source", "line_no", "nth") for k, (_, cell) in _KEYS.items()]
    return reduce(DataFrame.unionByName, out)


@query(f"select source, 'date time user-' || right(source, 1) || ' sc-status bytes' fields, count(*) n, sum(floor(value))::bigint bytes from {_EVENTS} group by source")
def q_w3c_fields(spark, d):
    """Sources that name their fields by directives, each in its own way; a later directive is not the first one."""
    lines = event_lines(spark, d, "w3c")
    sources_of = lines.select("source").distinct()
    directive = F.concat(F.lit("#Fields: date time  user-"), F.right("source", F.lit(1)), F.lit(" sc-status bytes"))
    lines = lines.unionByName(sources_of.select("source", F.lit(-2).cast("long").alias("line_no"), directive.alias("raw"))).unionByName(sources_of.select("source", F.lit(-1).cast("long").alias("line_no"), F.lit("#Fields: other").alias("raw")))
    named = ingest.w3c_fields(lines).select("source", F.array_join("fields", " ").alias("fields"))
    r = ingest.w3c(lines, ["date", "time", "user", "status", "bytes"]).filter("is_record").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("bytes").cast("long")).alias("bytes"))
    return r.join(named, "source")


def _generations(spark, d) -> DataFrame:
    """(source, gen, line_no, raw) of a folder of growing files, one for each source. The first half of the events is read first; then app-0 and app-1 grow by the others, and app-2 and app-3 are written anew with them.

    The shared folder must be a mounted one here.
    """
    folder, made = own_path(spark, "generations"), own_path(spark, "generations-files")
    e = event_fields(spark, d)
    half = ((e.agg(F.max("event_id")).first()[0] or 0) + 1) // 2
    rows = e.withColumn("part", (F.col("event_id") >= half).cast("int"))
    rows.repartition("part", "source").sortWithinPartitions("part", "source", "event_id").select("part", "source", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("raw")).write.partitionBy("part", "source").option("lineSep", "\n").text(made)
    local = folder.removeprefix("file://")
    if "://" in local:
        raise RuntimeError(f"{local} is not a mounted folder")
    os.makedirs(local)
    files = sorted(r["f"].removeprefix("file://") for r in spark.read.text(made, recursiveFileLookup=True).select(F.input_file_name().alias("f")).distinct().collect())  # two files for each source

    def put(part: int) -> None:
        for f in files:
            k, source = re.search("part=(.)/source=([^/]+)/", f).groups()
            if int(k) == part:
                with open(f, "rb") as a, open(f"{local}/{source}.log", "ab" if source in ("app-0", "app-1") else "wb") as b:
                    shutil.copyfileobj(a, b)

    out = own_path(spark, "stream-out")
    stream = live.growing_lines(spark, local, own_path(spark, "progress").removeprefix("file://"), span=1 << 14, batch=1 << 18, most=64 << 20)
    put(0)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", own_path(spark, "stream")).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    put(1)
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(stream.schema).parquet(out).select(F.regexp_extract("source", "([^/]+)[.]log$", 1).alias("source"), "gen", "line_no", "raw")


_GENERATIONS = f"(select source, event_type, event_id || ' ' || event_type raw, case when source in ('app-2', 'app-3') and event_id >= (max(event_id) over () + 1) // 2 then 1 else 0 end gen, event_id from {_EVENTS})"


@query(f"select source, gen, row_number() over (partition by source, gen order by event_id) - 1 line_no, raw from {_GENERATIONS}")
def q_generations(spark, d):
    """Files that grow, and files that are written anew while they are read: these start a new generation, whose lines are numbered from 0."""
    return _generations(spark, d)


@query(f"select source, gen, count(*) n from {_GENERATIONS} where event_type = 'error' group by 1, 2")
def q_generation_counts(spark, d):
    """Counts of a live search begin anew with a file's new generation."""
    path = own_path(spark, "generation-lines")
    lines = _generations(spark, d)
    lines.write.parquet(path)
    return _last(spark, live.live_counts(spark.readStream.schema(lines.schema).parquet(path), P.text(F.col("raw"), "error")))


@query(_SQL["q_stream_alerts"])
def q_alert_delivery(spark, d):
    """The alerts of a stream, handed batch by batch to a function of the caller's."""
    path = own_path(spark, "delivered")
    s = _event_stream(spark, d).filter(P.text(F.col("raw"), "error")).select("source", F.lit("error").alias("rule"), F.timestamp_micros((F.col("line_no") / 4 * 60_000_000).cast("long")).alias("ts"), "raw")
    alerts = live.live_alerts(s, 3600, timers=False)

    def notify(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    live.deliver(alerts, notify).option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alerts.schema).option("recursiveFileLookup", True).parquet(path).select("source", "us", "suppressed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
