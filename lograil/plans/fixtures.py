"""Log lines made from the given tables by expressions, so that ingest is tested end to end against the original columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table in few splits is dealt out to all cores, as making and reading lines costs more than moving rows; a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (source, line_no) with the parts of their log lines."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in {"error": "ERROR", "purchase": "WARN", "signup": "INFO", "click": "DEBUG", "view": "TRACE"}.items() for x in kv]), F.col("event_type"))
    return e.select(
        "event_id", "user_id", "event_type", "value", "ts", F.get_json_object("props", "$.k").alias("k"), F.concat(F.lit("app-"), (F.col("user_id") % 4).cast("string")).alias("source"), (F.col("event_id") * 4).alias("line_no"),
        level.alias("level"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"), F.format_string("%.2f", "value").alias("dur"),
    )


def event_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(source, line_no, raw) of events in a log format."""
    e = spread(event_fields(spark, sf_dir))
    s = lambda c: F.col(c).cast("string")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "purchase", 404).when(F.col("event_type") == "signup", 301).otherwise(200).cast("string")
    size = F.floor("value").cast("string")
    raw = {
        "logfmt": F.concat(F.lit("ts="), "iso", F.lit(" level="), F.lower("level"), F.lit(" user="), s("user_id"), F.lit(" dur="), "dur", F.lit("ms k="), "k", F.lit(' msg="event '), s("event_id"), F.lit(' \\"'), "event_type", F.lit('\\""')),
        "jsonl": F.concat(F.lit('{"ts":"'), "iso", F.lit('","level":"'), F.lower("level"), F.lit('","user":{"id":'), s("user_id"), F.lit('},"dur":'), "dur", F.lit(',"props":{"k":'), "k", F.lit('},"msg":"event '), s("event_id"), F.lit('"}')),
        "csv": F.concat_ws(",", "iso", "level", s("user_id"), "dur", F.concat(F.lit('"event '), s("event_id"), F.lit(', ""'), "event_type", F.lit('"""'))),
        "access": F.concat(F.lit("10.0.0."), s("user_id"), F.lit(" - u"), s("user_id"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "event_type", F.lit("/"), s("event_id"), F.lit(' HTTP/1.1" '), status, F.lit(" "), size, F.lit(' "-" "agent/1.0"')),
        "syslog_3164": F.concat(F.lit("<11>"), F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.lit(" "), F.date_format("ts", "HH:mm:ss"), F.lit(" "), "source", F.lit(" svc["), s("user_id"), F.lit("]: event "), s("event_id")),
        "syslog_5424": F.concat(F.lit("<131>1 "), "iso", F.lit(" "), "source", F.lit(" svc "), s("user_id"), F.lit(" ID"), s("event_id"), F.lit(' [m@1 k="'), "k", F.lit('"] event '), s("event_id")),
        "log4j": F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), F.rpad("level", 5, " "), F.lit(" [worker-"), s("user_id"), F.lit("] app.Svc - event "), s("event_id")),
        "w3c": F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.when(F.col("user_id") % 10 == 0, "-").otherwise(s("user_id")), status, size),
        "fixed": F.concat(F.rpad("level", 6, " "), F.rpad(s("user_id"), 7, " "), F.rpad("dur", 11, " "), F.lit("event "), s("event_id")),
    }[kind]
    return e.select("source", "line_no", raw.alias("raw"))


def with_continuations(lines: DataFrame) -> DataFrame:
    """Three continuation lines after errors whose event number is a multiple of 7."""
    traced = (F.floor(F.col("line_no") / 4) % 7 == 0) & F.lower("raw").contains("error")
    rows = F.when(traced, F.array(F.struct(F.lit(0).alias("o"), F.col("raw").alias("t")), *[F.struct(F.lit(i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(("\tat app.Svc.handle(Svc.java:12)", "Caused by: app.Err", "\t... 3 more"), 1)])).otherwise(F.array(F.struct(F.lit(0).alias("o"), F.col("raw").alias("t"))))
    return lines.select("source", "line_no", F.explode(rows).alias("x")).select("source", (F.col("line_no") + F.col("x.o")).alias("line_no"), F.col("x.t").alias("raw"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, line_no, raw): documents split into lines; source is the document's id."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("source"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw")).withColumn("line_no", F.col("line_no").cast("long"))
