"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import detect, readers
from ..streaming import events
from .catalog import query
from .reports import _HEAD, head


@query("detect_format", r"SELECT doc_id, CASE WHEN regexp_matches(h, '^<!doctype html|^<html', 'i') THEN 'html' WHEN starts_with(h, '<svg') THEN 'svg' WHEN regexp_matches(h, '^<\?xml|^<[A-Za-z][^>]*>') THEN 'xml' WHEN regexp_matches(h, '^\{[^\n]*\}\n\{') THEN 'jsonl' WHEN regexp_matches(h, '^[\[{]') THEN 'json' WHEN regexp_matches(h, '(?m)^#{1,6} \S|^```|^[-*] \S') THEN 'md' WHEN regexp_matches(h, '^[^\n\t]+\t[^\n]+\n[^\n\t]+\t') THEN 'tsv' ELSE 'txt' END AS guess FROM (SELECT doc_id, ltrim(substr(text, 1, 8192), ' ') AS h FROM documents WHERE text IS NOT NULL)")
def detect_format(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", detect.by_content(F.col("text")).alias("guess"))


@query("media_types", "SELECT doc_ord, lower(regexp_extract(uri, '\\.([A-Za-z0-9]+)$', 1)) AS format, media_type AS media FROM doc")
def media_types(spark, d):
    token = detect.by_extension(F.col("uri"))
    return table(spark, d, "doc").select("doc_ord", token.alias("format"), detect.media_type(token).alias("media"))


@query("text_paragraphs", r"SELECT doc_id, CAST(ord - 1 AS INTEGER) AS ord, text FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS ord FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL))")
def text_paragraphs(spark, d):
    return readers.paragraphs(table(spark, d, "documents"), "doc_id", "text")


@query("read_documents")
def read_documents(spark, d):
    """Every document by the reader of its detected format."""
    docs = table(spark, d, "documents").select("doc_id", detect.by_content(F.col("text")).alias("guess"), "text")
    return readers.read_blocks(docs, "doc_id", "guess", "text")


@query("render_documents")
def render_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("md").alias("form"), "text")
    return readers.render_markdown(readers.read_blocks(docs, "doc_id", "form", "text"), "doc_id")


@query("segment_views", f"WITH m AS (SELECT content_digest, unnest(member_ids) AS block_id, generate_subscripts(member_ids, 1) AS i FROM segment), b AS (SELECT block_id, coalesce(text, '') AS text FROM ({_HEAD})) SELECT content_digest, string_agg(text, chr(10) ORDER BY i) AS view FROM m JOIN b USING (block_id) GROUP BY content_digest")
def segment_views(spark, d):
    """The text view of each segment."""
    members = table(spark, d, "segment").select("content_digest", F.posexplode("member_ids").alias("i", "block_id"))
    joined = members.join(head(spark, d).select("block_id", F.coalesce("text", F.lit("")).alias("text")), "block_id")
    return joined.groupBy("content_digest").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("view"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query("event_log_roundtrip", "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type")
def event_log_roundtrip(spark, d):
    """Events written as NDJSON shards and read again."""
    path = events.work_dir(spark) + "/log"
    events.write_log(table(spark, d, "events"), path)
    good, _ = events.read_log(spark, path)
    return good.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query("hourly_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def hourly_events(spark, d):
    """Event-time windows, computed by a stream that is drained to its end."""
    out = events.run_to_end(events.tumbling(events.stream_table(spark, f"{d}/events.parquet")), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sliding_events", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def sliding_events(spark, d):
    return events.sliding(table(spark, d, "events"))


@query("user_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM i GROUP BY user_id, k")
def user_sessions(spark, d):
    return events.sessions(table(spark, d, "events"))


_SPANS = "SELECT user_id, event_id AS id, ts FROM events WHERE event_type = '{}'"


@query("span_pairs", f"SELECT a.user_id, a.id AS start_id, b.id AS end_id, a.ts AS started, b.ts AS ended FROM ({_SPANS.format('view')}) a JOIN ({_SPANS.format('purchase')}) b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def span_pairs(spark, d):
    """Views and the purchases of the same user within an hour, by a stream-stream join; the table is one batch, as its files may stand in any order of time."""
    of = lambda kind: events.stream_table(spark, f"{d}/events.parquet", None).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "ts")
    out = events.run_to_end(events.pair_spans(of("view"), of("purchase"), "user_id"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("tail_sample")
def tail_sample(spark, d):
    """All events of users with an error above 90, and of five in a hundred of the others."""
    return events.tail_sample(table(spark, d, "events"), "user_id", (F.col("event_type") == "error") & (F.col("value") > 90), 5).select("event_id", "user_id", "event_type")


@query("late_events", "SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events) WHERE ts < seen")
def late_events(spark, d):
    """Events that arrive after a later one of their user."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").withColumn("seen", F.max("ts").over(order)).where("ts < seen").select("event_id")
