"""Reports for review and routing: scoreboards, guards, signals, demand, synopses, removal suites, rendered answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, stats
from ..operators import derive, graph, retrieval
from ..session import table
from .catalog import query
from .reports import _HEAD, _VERDICT, head, verdicts
from .search import _BM25, lexical, questions


@query("review_order", f"WITH g AS (SELECT lower(text) AS name, min(trust) AS weakest, count(*) AS members, count(*) FILTER (WHERE trust = 0) AS tainted FROM ({_HEAD}) WHERE kind IN ('heading', 'title') AND text <> '' GROUP BY 1) SELECT name, weakest, members, tainted FROM g WHERE members >= 2 OR tainted > 0")
def review_order(spark, d):
    """Groups of names to be reviewed, with their weakest member and their tainted ones; sort by (weakest, tainted desc, name)."""
    g = head(spark, d, "kind IN ('heading', 'title') AND text <> ''").groupBy(F.lower("text").alias("name"))
    return g.agg(F.min("trust").alias("weakest"), F.count("*").alias("members"), F.count_if(F.col("trust") == 0).alias("tainted")).where("members >= 2 OR tainted > 0")


@query("route_scoreboard", "SELECT suite, subject, count(*) AS runs, round(count(*) FILTER (WHERE status = 'ok') / count(*), 9) AS ok, CAST(sum(spend_micros) AS BIGINT) AS micros, rank() OVER (PARTITION BY suite ORDER BY count(*) FILTER (WHERE status = 'ok') / count(*) DESC, sum(spend_micros), subject) AS place FROM eval_run GROUP BY suite, subject")
def route_scoreboard(spark, d):
    """Subjects of each suite by their share of good runs, then by what they spent; the window holds a row a subject."""
    s = table(spark, d, "eval_run").groupBy("suite", "subject").agg(F.count("*").alias("runs"), (F.count_if(F.col("status") == "ok") / F.count("*")).alias("share"), F.sum("spend_micros").alias("micros"))
    order = Window.partitionBy("suite").orderBy(F.desc("share"), "micros", "subject")
    return s.select("suite", "subject", "runs", F.round("share", 9).alias("ok"), "micros", F.rank().over(order).alias("place"))


@query("attribution_guard", f"WITH v AS (SELECT run_id, sum(micros) AS m FROM ({_VERDICT}) GROUP BY run_id) SELECT suite, CAST(sum(spend_micros) AS BIGINT) AS spent, CAST(coalesce(sum(m), 0) AS BIGINT) AS attributed, coalesce(sum(m), 0) > sum(spend_micros) AS over FROM eval_run r LEFT JOIN v USING (run_id) GROUP BY suite")
def attribution_guard(spark, d):
    """What verdicts attribute to a suite must not exceed what its runs spent."""
    v = verdicts(spark, d).groupBy("run_id").agg(F.sum("micros").alias("m"))
    s = table(spark, d, "eval_run").select("run_id", "suite", "spend_micros").join(v, "run_id", "left").groupBy("suite").agg(F.sum("spend_micros").alias("spent"), F.coalesce(F.sum("m"), F.lit(0)).alias("attributed"))
    return s.withColumn("over", F.col("attributed") > F.col("spent"))


@query("stale_lexicon", "WITH n AS (SELECT lower(label) AS name, bool_or(state = 0) AS now FROM block WHERE label IS NOT NULL GROUP BY 1) SELECT DISTINCT s.segment_id, n.name FROM (SELECT segment_id, lower(unnest(heading_path)) AS name FROM segment WHERE state = 0) s JOIN n USING (name) WHERE NOT n.now")
def stale_lexicon(spark, d):
    """Live segments under headings whose name only a retired generation bears: their names must be sought again."""
    n = table(spark, d, "block").where("label IS NOT NULL").groupBy(F.lower("label").alias("name")).agg(F.bool_or(F.col("state") == 0).alias("now")).where("NOT now")
    s = table(spark, d, "segment").where("state = 0").select("segment_id", F.explode("heading_path").alias("h")).select("segment_id", F.lower("h").alias("name"))
    return s.join(n.select("name"), "name").select("segment_id", "name").distinct()


@query("signals", f"WITH b AS (SELECT doc_ord, count(*) AS blocks, count(*) FILTER (WHERE method LIKE 'ocr%') AS ocr, sum(length(text)) AS chars, min(trust) AS trust FROM ({_HEAD}) GROUP BY doc_ord) SELECT d.doc_ord, d.format, d.page_count, b.blocks, round(b.ocr / b.blocks, 9) AS ocr_share, CAST(b.chars AS BIGINT) AS chars, b.trust FROM doc d LEFT JOIN b USING (doc_ord)")
def signals(spark, d):
    """Evidence for routing, a nullable column a key: what is not known stays null."""
    b = head(spark, d).groupBy("doc_ord").agg(F.count("*").alias("blocks"), F.count_if(F.col("method").like("ocr%")).alias("ocr"), F.sum(F.char_length("text")).alias("chars"), F.min("trust").alias("trust"))
    rows = table(spark, d, "doc").select("doc_ord", "format", "page_count").join(b, "doc_ord", "left")
    return rows.select("doc_ord", "format", "page_count", "blocks", F.round(F.col("ocr") / F.col("blocks"), 9).alias("ocr_share"), "chars", "trust")


@query("demand_plan", "SELECT doc_ord, CASE WHEN format IN ('md', 'txt') THEN 1 WHEN source_bytes < 200000 THEN 2 WHEN page_count IS NOT NULL THEN 3 ELSE 4 END AS group_needed FROM doc")
def demand_plan(spark, d):
    """The cheapest group of signals that decides a document's route: its format, its size, its pages, its blocks."""
    return table(spark, d, "doc").select("doc_ord", F.when(F.col("format").isin("md", "txt"), 1).when(F.col("source_bytes") < 200_000, 2).when(F.col("page_count").isNotNull(), 3).otherwise(4).alias("group_needed"))


#: Retrieval rules in their order: name, condition over the question, strategy.
RULES = [("named", "text RLIKE '[0-9]'", "exact"), ("short", "size(split(text, ' ')) <= 2", "identity"), ("any", "true", "lexical")]


@query("retrieval_rules", "SELECT block_id, CASE WHEN regexp_matches(text, '[0-9]') THEN 'named' WHEN len(string_split(text, ' ')) <= 2 THEN 'short' ELSE 'any' END AS rule FROM (" + _HEAD + ") WHERE kind = 'heading' AND text IS NOT NULL")
def retrieval_rules(spark, d):
    """The first rule that a question meets; every heading asked as one."""
    rows = head(spark, d, "kind = 'heading' AND text IS NOT NULL").select("block_id", "text")
    first = F.get(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c, _ in RULES])), 0)
    return rows.select("block_id", first.alias("rule"))


@query("table_synopsis", "WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey AS table_id, o_orderkey AS row_id, n > 12 AS synopsis FROM l WHERE n <= 12 OR r <= 8")
def table_synopsis(spark, d):
    """Tables of more than twelve rows are shown by their first eight: the synopsis; smaller ones whole."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row_id"))
    size = rows.groupBy("table_id").agg(F.count("*").alias("n"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("table_id").orderBy("row_id"))).where("r <= 12")
    return first.join(size, "table_id").where("n <= 12 OR r <= 8").select("table_id", "row_id", (F.col("n") > 12).alias("synopsis"))


@query("removal_suite", f"WITH a AS (SELECT DISTINCT assertion_id, doc, page, json_extract_string(spec, '$.text') AS q FROM eval_assertion WHERE type = 'present' AND json_valid(spec)), m AS (SELECT a.assertion_id, h.block_id, a.q, h.text FROM a JOIN doc d ON d.uri = a.doc JOIN ({_HEAD}) h ON h.doc_ord = d.doc_ord AND h.page = a.page WHERE a.q <> '' AND contains(h.text, a.q)) SELECT assertion_id, block_id, NOT contains(replace(text, q, ''), q) AS absent FROM m")
def removal_suite(spark, d):
    """Ground truth for absence: the quotation is taken out of each block that holds it, and must then be absent."""
    a = table(spark, d, "eval_assertion").where("type = 'present'").select("assertion_id", F.col("doc").alias("uri"), "page", F.expr("try_variant_get(try_parse_json(spec), '$.text', 'string')").alias("q")).where("q <> ''").distinct()
    docs = table(spark, d, "doc").select("doc_ord", "uri")
    met = a.join(docs, "uri").join(head(spark, d).select("block_id", "doc_ord", "page", "text"), ["doc_ord", "page"]).where(F.contains("text", "q"))
    return met.select("assertion_id", "block_id", (~F.contains(F.replace("text", "q", F.lit("")), F.col("q"))).alias("absent"))


@query("queue_waits", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def queue_waits(spark, d):
    """Nearest-rank percentiles of each kind of event, from counts of distinct values: no group lies in one array."""
    return stats.nearest_ranks(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("answer_text", f"WITH {_BM25}, r AS (SELECT query_id, block_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, block_id) AS rank FROM b) SELECT query_id, '# answer' || chr(10) || string_agg('[' || h.cite || '] ' || h.text, chr(10) ORDER BY rank) AS answer FROM r JOIN h USING (block_id) WHERE rank <= 5 GROUP BY query_id")
def answer_text(spark, d):
    """The first five hits of each question, rendered with their cites."""
    hits = retrieval.ranked(lexical(spark, d).withColumn("score", F.round("score", 9)), 5).join(head(spark, d).select("block_id", "cite", "text"), "block_id")
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "cite", F.lit("] "), "text").alias("line"))))
    return hits.groupBy("query_id").agg(F.concat(F.lit("# answer\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("answer"))


@query("lexical_lifted")
def lexical_lifted(spark, d):
    """Body scores lifted by the best decayed score of the headings above a block."""
    h = head(spark, d)
    titles = h.where("kind IN ('heading', 'title') AND text IS NOT NULL").select("block_id", "text")
    size = titles.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size(F.split("text", " "))), F.lit(1.0)).alias("mean_length"))
    of_titles = retrieval.bm25(retrieval.postings(titles, "block_id", "text", retrieval.query_terms(questions(spark))), "block_id", questions(spark), size)
    above = derive.heading_path(h).where("heading_id IS NOT NULL AND heading_id <> block_id").select("block_id", "heading_id", F.lit(1).alias("distance"))
    return retrieval.lift_headings(lexical(spark, d), of_titles, above).select("query_id", "block_id", F.round("score", 6).alias("score"))


@query("quads")
def quads(spark, d):
    """The first eight numbers of each vector as four points of a page, in thousandths, clockwise from the top left."""
    return table(spark, d, "embeddings").select("vec_id", geometry.ordered_quad(F.slice("embedding", 1, 8)).alias("quad"))


@query("decided_names")
def decided_names(spark, d):
    """Names of the same key merged, with what users decided: a split keeps two apart whatever else joins them."""
    named = head(spark, d, "kind IN ('heading', 'title') AND text <> ''").groupBy(F.lower("text").alias("name")).agg(F.min("block_id").alias("id"))
    key = F.regexp_replace("name", r"[^\p{L}]+", "")
    least = named.groupBy(key.alias("k")).agg(F.min("id").alias("a"))
    pairs = named.select("id", key.alias("k")).join(least, "k").where("id <> a AND k <> ''").select("a", F.col("id").alias("b"), F.lit(100.0).alias("score"))
    splits = pairs.where("b % 7 = 0").select("a", "b")
    return graph.closure(pairs, splits)
