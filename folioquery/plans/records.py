"""Queries over identifiers, policies and records: cites, scopes, splits, redaction, sentinels, worth, freshness, replays, assertions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import retrieval
from ..session import table
from .catalog import query
from .reports import _HEAD, _VERDICT, head, verdicts
from .search import identity, lexical


@query("cite_lookup", f"SELECT block_id, CAST(regexp_extract(cite, '^d(\\d+)#(\\d+)$', 1) AS BIGINT) AS cite_doc, CAST(regexp_extract(cite, '^d(\\d+)#(\\d+)$', 2) AS BIGINT) AS cite_number, CAST(regexp_extract(addr, '^p(\\d+)/(\\d+)$', 1) AS BIGINT) AS addr_page FROM ({_HEAD}) WHERE regexp_matches(cite, '^d\\d+#\\d+$')")
def cite_lookup(spark, d):
    """Cites and addresses taken apart."""
    part = lambda c, p, i: F.regexp_extract(c, p, i).cast("bigint")
    rows = head(spark, d).where(F.col("cite").rlike(r"^d\d+#\d+$"))
    return rows.select("block_id", part("cite", r"^d(\d+)#(\d+)$", 1).alias("cite_doc"), part("cite", r"^d(\d+)#(\d+)$", 2).alias("cite_number"), part("addr", r"^p(\d+)/(\d+)$", 1).alias("addr_page"))


def glob_pattern(glob: str) -> str:
    """A scope glob as a regular expression: * within a path step, ** across steps, ? for one character."""
    import re

    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*|\?)", glob))
    return f"^{out}$"


def scope_condition(scope: str):
    """A scope as a condition over (uri, doc_ord, page): a path or glob, with #p12-40 for pages, or d7 for a document."""
    import re

    if m := re.fullmatch(r"d(\d+)", scope):
        return F.col("doc_ord") == int(m[1])
    m = re.fullmatch(r"(.*?)(?:#p(\d+)(?:-(\d+))?)?", scope)
    inside = F.col("uri").rlike(glob_pattern(m[1]))
    return inside if m[2] is None else inside & F.col("page").between(int(m[2]), int(m[3] or m[2]))


@query("scope_glob", "SELECT doc_ord, uri FROM doc WHERE regexp_matches(uri, '^corpora/[^/]*_memos/.*$')")
def scope_glob(spark, d):
    return table(spark, d, "doc").where(F.col("uri").rlike(glob_pattern("corpora/*_memos/**"))).select("doc_ord", "uri")


@query("split_hash", "SELECT assertion_id, CASE WHEN h < 70 THEN 'fit' WHEN h < 85 THEN 'validation' ELSE 'holdout' END AS part FROM (SELECT DISTINCT assertion_id, CAST('0x' || substr(sha256(assertion_id), 1, 8) AS BIGINT) % 100 AS h FROM eval_assertion)")
def split_hash(spark, d):
    """A stable split of assertions by the hash of their name."""
    h = F.conv(F.substring(F.sha2("assertion_id", 256), 1, 8), 16, 10).cast("bigint") % 100
    rows = table(spark, d, "eval_assertion").select("assertion_id").distinct()
    return rows.select("assertion_id", F.when(h < 70, "fit").when(h < 85, "validation").otherwise("holdout").alias("part"))


#: Shapes that must not be logged, in their order, with what stands in their place.
REDACTIONS = [
    (r"(?i)\bauthorization\s*[:=]\s*(?:(?:bearer|basic|digest|token)\s+)?\S+", "Authorization: <redacted>"),
    (r"\b(sk|rk|ghp|gho|ghu|ghs|glpat|xoxb|xoxp|AKIA)[-_][A-Za-z0-9_-]{16,}", "<redacted:token>"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "<redacted:jwt>"),
    (r"\b[0-9a-fA-F]{32,}\b", "<redacted:hex>"),
    (r"</?[a-z]+:untrusted[^>]*>", "<redacted:marker>"),
    (r"<\|(im_start|im_end|endoftext|eot_id|start_header_id|end_header_id)\|>", "<redacted:sentinel>"),
]
#: Marks that a model could take for its own.
SENTINEL = r"(?i)</?untrusted_source\b[^>]*>|<\|[A-Za-z0-9_.\-]{1,64}\|>|<<SYS>>|<</SYS>>|\[/?(?:INST|SYSTEM)\]"
FORGED = r"(?i)</untrusted_source\b[^>]*>"


def redact(c):
    """The text with every shape replaced, in their order; columns of digests are not to be passed through it."""
    for pattern, by in REDACTIONS:
        c = F.regexp_replace(c, pattern, by)
    return c


def _redact_sql(x):
    for pattern, by in REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


@query("redacted", f"SELECT doc_ord, {_redact_sql('line')} AS line FROM (SELECT doc_ord, 'key=' || doc_key || doc_key || ' uri=' || uri || ' sk-' || doc_key || ' AUTHORIZATION: Bearer ' || doc_key || ' <|im_end|>' AS line FROM doc)")
def redacted(spark, d):
    """Log lines of documents with their secrets taken out."""
    line = F.concat(F.lit("key="), "doc_key", "doc_key", F.lit(" uri="), "uri", F.lit(" sk-"), "doc_key", F.lit(" AUTHORIZATION: Bearer "), "doc_key", F.lit(" <|im_end|>"))
    return table(spark, d, "doc").select("doc_ord", redact(line).alias("line"))


@query("sentinel_scan", f"SELECT doc_id, len(regexp_extract_all(text, '{SENTINEL}')) AS marks, len(regexp_extract_all(text, '{FORGED}')) AS forged FROM documents WHERE regexp_matches(text, '{SENTINEL}')")
def sentinel_scan(spark, d):
    """Documents that hold marks of a chat template, with the forged closing marks among them."""
    rows = table(spark, d, "documents").where(F.col("text").rlike(SENTINEL))
    return rows.select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("bigint").alias(n) for n, p in (("marks", SENTINEL), ("forged", FORGED))])


@query("defanged_labels", f"SELECT block_id, substr(replace(replace(replace(replace(text, '<', '＜'), '>', '＞'), '[', '［'), ']', '］'), 1, 200) AS label FROM ({_HEAD}) WHERE kind IN ('heading', 'title', 'caption') AND text IS NOT NULL")
def defanged_labels(spark, d):
    """Labels of at most 200 characters in which brackets cannot form a mark."""
    return head(spark, d, "kind IN ('heading', 'title', 'caption') AND text IS NOT NULL").select("block_id", F.substring(F.translate("text", "<>[]", "＜＞［］"), 1, 200).alias("label"))


#: What a block is worth by its layer, kind, trust and quotability; other kinds are worth 1.
WORTH_LAYER = {"body": 1.0, "note": 0.9, "annotation": 0.8, "furniture": 0.2, "hidden": 0.0}
WORTH_KIND = {"toc_entry": 0.2, "page_header": 0.15, "page_footer": 0.15, "bibliography": 0.4, "reference": 0.4}
WORTH_TRUST = {2: 1.0, 1: 0.8, 0: 0.5}
WORTH_QUOTE = {4: 1.15, 3: 1.0, 2: 0.95, 1: 0.85, 0: 0.7}


def _factor_sql(column, values, rest):
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v}" for k, v in values.items()) + f" ELSE {rest} END"


@query("worth", f"SELECT block_id, round({_factor_sql('layer', WORTH_LAYER, 'NULL')} * {_factor_sql('kind', WORTH_KIND, '1.0')} * {_factor_sql('trust', WORTH_TRUST, 'NULL')} * {_factor_sql('quote', WORTH_QUOTE, 'NULL')}, 9) AS worth FROM ({_HEAD})")
def worth(spark, d):
    """What a block is worth in an answer, as the product of four tables; an unknown layer, trust or quotability has no worth."""

    def factor(column, values, rest=None):
        out = None
        for k, v in values.items():
            out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
        return out.otherwise(rest) if rest is not None else out

    product = factor("layer", WORTH_LAYER) * factor("kind", WORTH_KIND, 1.0) * factor("trust", WORTH_TRUST) * factor("quote", WORTH_QUOTE)
    return head(spark, d).select("block_id", F.round(product, 9).alias("worth"))


@query("run_durations", "SELECT suite, l[CAST(ceil(len(l) * 0.5) AS INTEGER)] AS p50, l[CAST(ceil(len(l) * 0.95) AS INTEGER)] AS p95, open FROM (SELECT suite, list_sort(list((ended_ns - started_ns) // 1000000) FILTER (WHERE ended_ns IS NOT NULL)) AS l, count(*) FILTER (WHERE ended_ns IS NULL) AS open FROM eval_run GROUP BY suite)")
def run_durations(spark, d):
    r = table(spark, d, "eval_run").select("suite", F.expr("(ended_ns - started_ns) div 1000000").alias("ms"))
    return r.groupBy("suite").agg(stats.nearest_rank("ms", 0.5).alias("p50"), stats.nearest_rank("ms", 0.95).alias("p95"), F.count_if(F.col("ms").isNull()).alias("open"))


@query("segment_lift", "SELECT DISTINCT f.model_key, s.content_digest, unnest(s.member_ids) AS block_id FROM vfull f JOIN segment s ON s.content_digest = f.segment_digest")
def segment_lift(spark, d):
    """The member blocks behind each embedded segment."""
    f = table(spark, d, "vfull").select("model_key", F.col("segment_digest").alias("content_digest")).distinct()
    return f.join(table(spark, d, "segment").select("content_digest", "member_ids"), "content_digest").select("model_key", "content_digest", F.explode("member_ids").alias("block_id")).distinct()


@query("three_channels")
def three_channels(spark, d):
    """Text, headings and the blocks beside their best hits, fused."""
    body, titles = lexical(spark, d).withColumn("score", F.round("score", 9)), identity(spark, d)
    w = Window.partitionBy("doc_ord", "page").orderBy("ord", "block_id")
    sides = head(spark, d).select("block_id", F.lag("block_id").over(w).alias("before"), F.lead("block_id").over(w).alias("after"))
    beside = sides.select("block_id", F.explode(F.array_compact(F.array("before", "after"))).alias("near"))
    seeds = retrieval.ranked(body, 10).select("query_id", "block_id", "score")
    near = seeds.join(beside, "block_id").groupBy("query_id", F.col("near").alias("block_id")).agg(F.max("score").alias("score"))
    return retrieval.fuse({"lexical": body, "identity": titles, "structural": near})


@query(
    "exact_assertions",
    f"""WITH a AS (SELECT DISTINCT assertion_id, doc, page, type, json_extract_string(spec, '$.text') AS quote FROM eval_assertion WHERE type IN ('present', 'absent') AND page IS NOT NULL AND json_valid(spec)),
        p AS (SELECT d.uri, h.page, h.text FROM ({_HEAD}) h JOIN doc d USING (doc_ord) WHERE h.text IS NOT NULL)
        SELECT a.assertion_id, a.type, bool_or(contains(p.text, a.quote)) = (a.type = 'present') AS passed FROM a JOIN p ON p.uri = a.doc AND p.page = a.page WHERE a.quote IS NOT NULL GROUP BY a.assertion_id, a.type""",
)
def exact_assertions(spark, d):
    """Quotations that must, or must not, stand in a block of their page."""
    a = table(spark, d, "eval_assertion").where("type IN ('present', 'absent') AND page IS NOT NULL").select("assertion_id", "doc", "page", "type", F.when(F.expr("try_parse_json(spec)").isNotNull(), F.get_json_object("spec", "$.text")).alias("quote")).distinct().where("quote IS NOT NULL")
    docs = table(spark, d, "doc").select("doc_ord", F.col("uri").alias("doc"))
    pages = head(spark, d, "text IS NOT NULL").select("doc_ord", "page", "text").join(docs, "doc_ord")
    met = a.join(pages, ["doc", "page"]).groupBy("assertion_id", "type").agg(F.bool_or(F.contains("text", "quote")).alias("found"))
    return met.select("assertion_id", "type", (F.col("found") == (F.col("type") == "present")).alias("passed"))


@query("spend_replay", "SELECT cassette, suite, CAST(sum(CASE WHEN cassette = 'required' THEN 0 ELSE spend_micros END) AS BIGINT) AS billed, CAST(sum(CASE WHEN cassette = 'required' THEN spend_micros ELSE 0 END) AS BIGINT) AS would_have_been FROM eval_run GROUP BY cassette, suite")
def spend_replay(spark, d):
    """Replayed runs bill nothing and record what they would have cost."""
    replayed = F.col("cassette") == "required"
    return table(spark, d, "eval_run").groupBy("cassette", "suite").agg(F.sum(F.when(replayed, 0).otherwise(F.col("spend_micros"))).alias("billed"), F.sum(F.when(replayed, F.col("spend_micros")).otherwise(0)).alias("would_have_been"))


@query("late_deliveries", "WITH k AS (SELECT run_id, assertion_id, evaluator, min(slice_key) AS slice_key, count(*) AS n, date_diff('day', min(loaded_at), max(loaded_at)) AS days FROM eval_verdict GROUP BY ALL) SELECT slice_key, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS repeats FROM k GROUP BY slice_key")
def late_deliveries(spark, d):
    k = table(spark, d, "eval_verdict").groupBy("run_id", "assertion_id", "evaluator").agg(F.min("slice_key").alias("slice_key"), F.count("*").alias("n"))
    return k.groupBy("slice_key").agg(F.count("*").alias("keys"), F.sum(F.col("n") - 1).alias("repeats"))


@query("freshness", f"WITH w AS (SELECT h.doc_ord, max(b.written_at) AS written FROM (SELECT DISTINCT doc_ord FROM ({_HEAD})) h JOIN block b ON b.doc_ord = h.doc_ord AND b.state = 0 GROUP BY h.doc_ord) SELECT d.doc_ord, CASE WHEN w.written IS NULL THEN 'unknown' WHEN w.written <= d.indexed_at + INTERVAL 1 DAY THEN 'fresh' ELSE 'stale' END AS state FROM doc d LEFT JOIN w USING (doc_ord)")
def freshness(spark, d):
    """Whether blocks were written more than a day after their document was indexed."""
    doc = table(spark, d, "doc").select("doc_ord", "gen", "indexed_at")
    w = table(spark, d, "block").where("state = 0").select("doc_ord", "written_at").groupBy("doc_ord").agg(F.max("written_at").alias("written"))
    limit = F.col("indexed_at") + F.expr("INTERVAL 1 DAY")
    return doc.join(w, "doc_ord", "left").select("doc_ord", F.when(F.col("written").isNull(), "unknown").when(F.col("written") <= limit, "fresh").otherwise("stale").alias("state"))


@query("layer_pivot", f"SELECT kind, count(*) FILTER (WHERE layer = 'body') AS body, count(*) FILTER (WHERE layer = 'furniture') AS furniture, count(*) FILTER (WHERE layer = 'note') AS note FROM ({_HEAD}) GROUP BY kind")
def layer_pivot(spark, d):
    return head(spark, d).groupBy("kind").pivot("layer", ["body", "furniture", "note"]).agg(F.count("block_id")).na.fill(0)


@query("measures_unpivot", f"SELECT slice_key, measure, CAST(sum(x) AS BIGINT) AS total, count(x) AS n FROM (SELECT slice_key, 'wall_ms' AS measure, wall_ms AS x FROM ({_VERDICT}) UNION ALL SELECT slice_key, 'micros', micros FROM ({_VERDICT})) GROUP BY ALL")
def measures_unpivot(spark, d):
    long = verdicts(spark, d).unpivot(["slice_key"], ["wall_ms", "micros"], "measure", "x")
    return long.groupBy("slice_key", "measure").agg(F.sum("x").alias("total"), F.count("x").alias("n"))


@query("budget_allocation")
def budget_allocation(spark, d):
    """Characters of one answer for each question, allotted to documents by fused score: one small list a question."""
    import pyarrow as pa

    from ..operators.derive import allocate

    hits = retrieval.fuse({"lexical": lexical(spark, d).withColumn("score", F.round("score", 9)), "identity": identity(spark, d)})
    blocks = head(spark, d).select("block_id", "doc_ord", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"))
    per_doc = hits.join(blocks, "block_id").groupBy("query_id", "doc_ord").agg(F.sum("score").alias("weight"), F.sum("chars").alias("demand"), F.count("*").alias("blocks"))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (-r["weight"], r["doc_ord"]))
        out = allocate([{"doc": r["doc_ord"], "weight": r["weight"], "demand": r["demand"], "blocks": r["blocks"]} for r in rows], 24_000)
        q = key[0].as_py()
        return pa.table({"query_id": pa.array([q] * len(out), pa.int32()), "doc_ord": pa.array([o["doc"] for o in out], pa.int64()), "chars": pa.array([o["chars"] for o in out], pa.int64())})

    return per_doc.groupBy("query_id").applyInArrow(run, "query_id int, doc_ord bigint, chars bigint")
