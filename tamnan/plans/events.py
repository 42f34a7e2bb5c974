"""Batch twins of the streaming operators, and chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import read
from tamnan.operators import chunks as C
from tamnan.operators.ranking import carried_within, ordinal_within
from tamnan.streaming import state as S


@register("SELECT event_id, user_id, ts FROM events WHERE event_type IN ('view', 'click') AND user_id IS NOT NULL")
def addressed_events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").where("event_type IN ('view', 'click') AND user_id IS NOT NULL").select("event_id", "user_id", "ts")


@register("SELECT event_id, user_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 900 SECOND THEN lag(event_type) OVER w END AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def chat_context_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return S.remembered(read(spark, sf, "events"))


@register("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return S.newest(read(spark, sf, "events").select("event_id", "ts", "user_id"))


@register("SELECT answer_id, id, logged_at FROM answers ORDER BY logged_at DESC, answer_id DESC LIMIT 20")
def newest_n(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "answers").select("answer_id", "id", "logged_at").orderBy(F.desc("logged_at"), F.desc("answer_id")).limit(20)


@register("SELECT answer_id, round(epoch(logged_at - asked_at), 3) AS latency_s, seconds FROM answers")
def response_latency(spark: SparkSession, sf: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, asked_at, logged_at)")
    return read(spark, sf, "answers").select("answer_id", F.round(us / 1e6, 3).alias("latency_s"), "seconds")


@register("SELECT user_id, row_number() OVER (ORDER BY min(ts), user_id)::INTEGER AS label FROM events GROUP BY 1")
def first_seen_label(spark: SparkSession, sf: str) -> DataFrame:
    """People are numbered by first appearance, in sorted ranges instead of one global sort."""
    per = read(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return ordinal_within(per, [], ["first", "user_id"], "label").select("user_id", F.col("label").cast("int").alias("label"))


@register("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS topic FROM events")
def topic_carry(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return carried_within(e, ["user_id"], ["ts", "event_id"], bought, "topic").select("event_id", "topic")


@register("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type", "user_id", "value")
    return e.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))


@register()
def chunk_at_space(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunked(read(spark, sf, "documents"), "doc_id", "text", C.chunk_at_space)


@register()
def chunk_at_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunked(read(spark, sf, "documents"), "doc_id", "text", C.chunk_at_paragraph)


@register()
def pack_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunked(read(spark, sf, "documents"), "doc_id", "text", C.pack_paragraphs)


@register()
def soft_hard_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunked(read(spark, sf, "documents"), "doc_id", "text", C.soft_hard)


_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


@register(f"SELECT doc_id, length(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS solid FROM documents WHERE trim(regexp_replace(text, '{_SPACE}', '', 'g')) <> ''")
def chunk_invariant(spark: SparkSession, sf: str) -> DataFrame:
    """What the chunks of a document hold besides white space is what the document holds."""
    parts = C.chunked(read(spark, sf, "documents"), "doc_id", "text", C.chunk_at_space)
    return parts.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("chunk", _SPACE, ""))).alias("solid")).where("solid > 0")


@register()
def budget_pick(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "passages").where("section IS NOT NULL").select(F.concat_ws("#", "sysid", "section").alias("grp"), F.col("passage_id").alias("pos"), F.length("text").alias("size"), (F.col("part") == 0).cast("int").alias("priority")).fillna(0, ["priority"])
    return C.budgeted(p, "grp", 2000)
