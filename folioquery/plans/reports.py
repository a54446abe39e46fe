"""Reports over the document, block, segment and evaluation tables: views, filters, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import filters
from ..session import table
from .catalog import query

_HEAD = "SELECT DISTINCT b.* EXCLUDE (written_at) FROM block b JOIN doc d ON d.doc_ord = b.doc_ord AND d.gen = b.gen WHERE b.state = 0"
_VERDICT = "SELECT DISTINCT run_id, assertion_id, evaluator, passed, score, slice_key, wall_ms, micros FROM eval_verdict"


def head(spark: SparkSession, d: str, where: str | None = None, only: filters.Filters | None = None) -> DataFrame:
    """The head view of the blocks; conditions given here reach the scan."""
    return filters.block_head(table(spark, d, "block"), table(spark, d, "doc"), only, F.expr(where) if where else None)


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each verdict once: the key's earliest delivery."""
    v = table(spark, d, "eval_verdict").select("run_id", "assertion_id", "evaluator", "passed", "score", "slice_key", "wall_ms", "micros", "loaded_at")
    return v.groupBy("run_id", "assertion_id", "evaluator").agg(F.min_by(F.struct("passed", "score", "slice_key", "wall_ms", "micros"), "loaded_at").alias("v")).select("run_id", "assertion_id", "evaluator", "v.*")


# Views, projections and filters


@query("block_head", f"SELECT block_id, doc_ord, page, ord, kind, layer, trust FROM ({_HEAD})")
def block_head(spark, d):
    return head(spark, d).select("block_id", "doc_ord", "page", "ord", "kind", "layer", "trust")


@query("segment_head", "SELECT s.segment_id, s.doc_ord, s.ord, s.n_chars FROM segment s JOIN doc d USING (doc_ord, gen) WHERE s.state = 0")
def segment_head(spark, d):
    return table(spark, d, "segment").where("state = 0").join(table(spark, d, "doc").select("doc_ord", "gen"), ["doc_ord", "gen"]).select("segment_id", "doc_ord", "ord", "n_chars")


@query("filter_query", f"SELECT h.block_id FROM ({_HEAD}) h JOIN doc d USING (doc_ord) WHERE d.format IN ('html', 'md', 'pdf') AND h.kind IN ('paragraph', 'heading') AND h.layer IN ('body') AND h.page BETWEEN 0 AND 3 AND h.trust >= 1 AND h.quote >= 1 AND h.method NOT IN ('llm') AND (h.restriction_bits & 5) = 0 AND starts_with(d.uri, 'corpora/')")
def filter_query(spark, d):
    wanted = filters.Filters(uri_prefix="corpora/", formats=("html", "md", "pdf"), kinds=("paragraph", "heading"), pages=(0, 3), min_trust=1, min_quote=1, deny_methods=("llm",), deny_bits=5)
    return head(spark, d, only=wanted).select("block_id")


@query("withheld_by_bit", f"SELECT CAST(bit AS BIGINT) AS bit, CAST(sum(CASE WHEN h.restriction_bits & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS withheld FROM ({_HEAD}) h, (VALUES (1), (2), (4), (8), (16)) t(bit) WHERE h.layer = 'body' AND h.trust >= 1 GROUP BY bit")
def withheld_by_bit(spark, d):
    return filters.withheld(head(spark, d), filters.Filters(min_trust=1), (1, 2, 4, 8, 16))


@query("section_prefix_range", f"SELECT block_id, '/' || lpad(CAST(page AS VARCHAR), 4, '0') || '/' || lpad(CAST(ord AS VARCHAR), 4, '0') AS sec_path FROM ({_HEAD}) WHERE page = 1 AND page IS NOT NULL AND ord IS NOT NULL")
def section_prefix_range(spark, d):
    rows = head(spark, d).select("block_id", text.section_path(F.array("page", "ord")).alias("sec_path"))
    return rows.where(text.prefix_range(F.col("sec_path"), "/0001"))


@query(
    "route_rules",
    """SELECT doc_ord, CASE WHEN coalesce(format = 'pdf' AND page_count > 6, false) THEN 'long_pdf' WHEN coalesce(page_count >= 4 OR source_bytes > 1000000, true) THEN 'large'
       WHEN page_count < 4 AND NOT (status = 'partial') THEN 'small' WHEN (page_count < 4 AND NOT (status = 'partial')) IS NULL THEN 'deferred:small' ELSE 'rest' END AS rule FROM doc""",
)
def route_rules(spark, d):
    p = filters.predicate
    rules = [
        ("long_pdf", filters.clause(all_of=[p("format", "eq", "pdf"), p("page_count", "gt", 6)]), "skip"),
        ("large", filters.clause(any_of=[p("page_count", "gte", 4), p("source_bytes", "gt", 1_000_000)]), "match"),
        ("small", filters.clause(all_of=[p("page_count", "lt", 4)], none_of=[p("status", "eq", "partial")]), "defer"),
    ]
    return table(spark, d, "doc").select("doc_ord", filters.first_rule(rules, "rest").alias("rule"))


@query("hit_record", f"SELECT h.block_id, h.cite, h.addr, d.uri, h.page, h.kind, h.layer, h.trust, h.quote, h.method, length(h.text) AS chars, (h.trust = 2 AND h.quote >= 3 AND h.method IN ('native', 'native_xml', 'text_layer')) AS verbatim FROM ({_HEAD}) h JOIN doc d USING (doc_ord)")
def hit_record(spark, d):
    rows = head(spark, d).join(table(spark, d, "doc").select("doc_ord", "uri"), "doc_ord")
    exact = (F.col("trust") == 2) & (F.col("quote") >= 3) & F.col("method").isin("native", "native_xml", "text_layer")
    return rows.select("block_id", "cite", "addr", "uri", "page", "kind", "layer", "trust", "quote", "method", F.char_length("text").cast("bigint").alias("chars"), exact.alias("verbatim"))


@query("canonical_projection", f"SELECT d.doc_key, h.addr, h.kind, h.layer, h.content_digest FROM ({_HEAD}) h JOIN doc d USING (doc_ord)")
def canonical_projection(spark, d):
    return head(spark, d).join(table(spark, d, "doc").select("doc_ord", "doc_key"), "doc_ord").select("doc_key", "addr", "kind", "layer", "content_digest")


@query("hash_sample", "SELECT doc_ord, doc_key FROM doc ORDER BY sha256(doc_key), doc_ord LIMIT 25")
def hash_sample(spark, d):
    """A deterministic sample operator: the 25 least keys by hash."""
    return table(spark, d, "doc").select("doc_ord", "doc_key").orderBy(F.sha2("doc_key", 256), "doc_ord").limit(25)


# Joins


@query(
    "cost_left_joins",
    """WITH q AS (SELECT l_orderkey, count(*) AS units, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem GROUP BY 1),
       s AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
       SELECT o.o_orderpriority, count(*) AS orders, CAST(sum(q.units) AS BIGINT) AS units, CAST(sum(q.returned) AS BIGINT) AS returned, CAST(sum(s.cents) AS BIGINT) AS cents, count(*) FILTER (WHERE s.cents IS NULL) AS never_charged
       FROM orders o LEFT JOIN q ON q.l_orderkey = o.o_orderkey LEFT JOIN s ON s.l_orderkey = o.o_orderkey GROUP BY 1""",
)
def cost_left_joins(spark, d):
    """Two one-to-many sides are aggregated before they are joined, so that neither multiplies the other."""
    line = table(spark, d, "lineitem")
    q = line.groupBy("l_orderkey").agg(F.count("*").alias("units"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    s = line.where("l_discount > 0.05").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return o.join(q, "l_orderkey", "left").join(s, "l_orderkey", "left").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum("units").alias("units"), F.sum("returned").alias("returned"), F.sum("cents").alias("cents"), F.count_if(F.col("cents").isNull()).alias("never_charged"))


@query("children_semi", f"WITH h AS ({_HEAD}) SELECT block_id FROM h p WHERE EXISTS (SELECT 1 FROM h c WHERE c.parent_id = p.block_id)")
def children_semi(spark, d):
    h = head(spark, d).select("block_id", "parent_id")
    return h.select("block_id").join(h.select(F.col("parent_id").alias("block_id")), "block_id", "left_semi")


@query("leaves_anti", f"WITH h AS ({_HEAD}) SELECT block_id FROM h p WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.parent_id = p.block_id)")
def leaves_anti(spark, d):
    h = head(spark, d).select("block_id", "parent_id")
    return h.select("block_id").join(h.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("block_id")), "block_id", "left_anti")


@query("stale_assertions", "SELECT DISTINCT a.assertion_id FROM eval_assertion a JOIN doc d ON d.uri = a.doc WHERE a.page IS NOT NULL AND d.page_count IS NOT NULL AND a.page >= d.page_count - 1")
def stale_assertions(spark, d):
    """Equi-join with a residual comparison."""
    a = table(spark, d, "eval_assertion").where("page IS NOT NULL").select("assertion_id", "doc", "page")
    docs = table(spark, d, "doc").where("page_count IS NOT NULL").select(F.col("uri").alias("doc"), "page_count")
    return a.join(docs, "doc").where("page >= page_count - 1").select("assertion_id").distinct()


@query("pending_without_vector", "SELECT DISTINCT p.model_key, p.segment_digest FROM vpending p WHERE NOT EXISTS (SELECT 1 FROM vfull f WHERE f.model_key = p.model_key AND f.segment_digest = p.segment_digest)")
def pending_without_vector(spark, d):
    keys = ["model_key", "segment_digest"]
    return table(spark, d, "vpending").select(*keys).distinct().join(table(spark, d, "vfull").select(*keys), keys, "left_anti")


@query("vector_coverage", "SELECT e.model_key, count(DISTINCT f.segment_digest) AS embedded, (SELECT count(DISTINCT segment_digest) FROM vpending p WHERE p.model_key = e.model_key) AS pending FROM embed_space e LEFT JOIN vfull f ON f.model_key = e.model_key AND len(f.v) = e.dim GROUP BY e.model_key")
def vector_coverage(spark, d):
    space = table(spark, d, "embed_space").select("model_key", "dim")
    full = table(spark, d, "vfull").join(space, "model_key").where(F.size("v") == F.col("dim")).groupBy("model_key").agg(F.count_distinct("segment_digest").alias("embedded"))
    pending = table(spark, d, "vpending").groupBy("model_key").agg(F.count_distinct("segment_digest").alias("pending"))
    return space.select("model_key").join(full, "model_key", "left").join(pending, "model_key", "left").na.fill(0)


# Aggregates


@query("method_histogram", f"SELECT method, trust, quote, count(*) AS n FROM ({_HEAD}) GROUP BY ALL")
def method_histogram(spark, d):
    return head(spark, d).groupBy("method", "trust", "quote").agg(F.count("*").alias("n"))


@query("corpus_counts", "SELECT count(*) AS docs, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status NOT IN ('ok', 'partial')) AS failed, CAST(sum(source_bytes) AS BIGINT) AS bytes, CAST(sum(page_count) AS BIGINT) AS pages, count(DISTINCT format) AS formats FROM doc")
def corpus_counts(spark, d):
    return table(spark, d, "doc").agg(F.count("*").alias("docs"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(~F.col("status").isin("ok", "partial")).alias("failed"), F.sum("source_bytes").alias("bytes"), F.sum("page_count").alias("pages"), F.count_distinct("format").alias("formats"))


@query("gaps", f"WITH h AS ({_HEAD}) SELECT kind, count(DISTINCT doc_ord) AS docs, count(DISTINCT (doc_ord, page)) AS pages, CAST(min(trust) AS INTEGER) AS worst FROM h WHERE text IS NULL OR text = '' OR trust = 0 GROUP BY kind")
def gaps(spark, d):
    bad = head(spark, d, "text IS NULL OR text = '' OR trust = 0")
    return bad.groupBy("kind").agg(F.count_distinct("doc_ord").alias("docs"), F.count_distinct("doc_ord", "page").alias("pages"), F.min("trust").alias("worst"))


@query("segment_members", f"WITH h AS ({_HEAD}), m AS (SELECT segment_id, unnest(member_ids) AS block_id FROM segment) SELECT segment_id, CAST(min(trust) AS INTEGER) AS trust, CAST(min(quote) AS INTEGER) AS quote, CAST(bit_or(restriction_bits) AS BIGINT) AS bits, count(*) AS blocks, list_sort(list(DISTINCT kind)) AS kinds FROM m JOIN h USING (block_id) GROUP BY segment_id")
def segment_members(spark, d):
    members = table(spark, d, "segment").select("segment_id", F.explode("member_ids").alias("block_id"))
    return members.join(head(spark, d).select("block_id", "trust", "quote", "restriction_bits", "kind"), "block_id").groupBy("segment_id").agg(F.min("trust").alias("trust"), F.min("quote").alias("quote"), F.bit_or("restriction_bits").alias("bits"), F.count("*").alias("blocks"), F.sort_array(F.collect_set("kind")).alias("kinds"))


@query(
    "cost_by_slice",
    """WITH x AS (SELECT c_mktsegment AS owner, l_returnflag AS class, l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS units FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
       SELECT owner, class, count(DISTINCT l_orderkey) AS orders, CAST(sum(units) AS BIGINT) AS units, CAST(sum(cents) AS BIGINT) AS cents FROM x GROUP BY owner, class""",
)
def cost_by_slice(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("class"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_quantity").cast("bigint").alias("units"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("owner"))
    return line.join(orders, "o_orderkey").join(customer, "c_custkey").groupBy("owner", "class").agg(F.count_distinct("o_orderkey").alias("orders"), F.sum("units").alias("units"), F.sum("cents").alias("cents"))


@query("cost_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def cost_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))


@query("slice_cube", f"SELECT evaluator, slice_key, count(*) AS n, CAST(sum(passed) AS BIGINT) AS k FROM ({_VERDICT}) GROUP BY CUBE (evaluator, slice_key)")
def slice_cube(spark, d):
    return verdicts(spark, d).cube("evaluator", "slice_key").agg(F.count("*").alias("n"), F.sum("passed").alias("k"))


@query("repeated_digests", f"SELECT content_digest, count(*) AS n, count(DISTINCT doc_ord) AS docs FROM ({_HEAD}) WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def repeated_digests(spark, d):
    return head(spark, d, "text IS NOT NULL").groupBy("content_digest").agg(F.count("*").alias("n"), F.count_distinct("doc_ord").alias("docs")).where("n >= 2")


@query("top_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM ({_HEAD}) WHERE text IS NOT NULL) WHERE length(term) > 3 GROUP BY term ORDER BY n DESC, term LIMIT 24")
def top_terms(spark, d):
    words = head(spark, d, "text IS NOT NULL").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("term")).where(F.length("term") > 3)
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(24)


@query("outline_sample", f"SELECT doc_ord, page, ord, block_id, text FROM ({_HEAD}) WHERE kind IN ('title', 'heading') AND text IS NOT NULL ORDER BY doc_ord, page, ord, block_id LIMIT 40")
def outline_sample(spark, d):
    return head(spark, d, "kind IN ('title', 'heading') AND text IS NOT NULL").select("doc_ord", "page", "ord", "block_id", "text").orderBy("doc_ord", "page", "ord", "block_id").limit(40)


@query("capability_floor", f"WITH k AS (SELECT doc_ord, CAST(min(trust) AS INTEGER) AS trust, CAST(min(quote) AS INTEGER) AS quote FROM ({_HEAD}) GROUP BY doc_ord) SELECT d.format, CAST(min(k.trust) AS INTEGER) AS trust_floor, CAST(min(k.quote) AS INTEGER) AS quote_floor, count(*) AS docs FROM k JOIN doc d USING (doc_ord) GROUP BY d.format")
def capability_floor(spark, d):
    per_doc = head(spark, d).groupBy("doc_ord").agg(F.min("trust").alias("trust"), F.min("quote").alias("quote"))
    return per_doc.join(table(spark, d, "doc").select("doc_ord", "format"), "doc_ord").groupBy("format").agg(F.min("trust").alias("trust_floor"), F.min("quote").alias("quote_floor"), F.count("*").alias("docs"))


@query("kinds_shared_by_formats", f"WITH h AS (SELECT DISTINCT d.format, b.kind FROM ({_HEAD}) b JOIN doc d USING (doc_ord)) SELECT kind FROM h GROUP BY kind HAVING count(*) = (SELECT count(DISTINCT format) FROM h)")
def kinds_shared_by_formats(spark, d):
    """Set intersection over groups."""
    pairs = head(spark, d).join(table(spark, d, "doc").select("doc_ord", "format"), "doc_ord").select("format", "kind").distinct()
    per_kind = pairs.groupBy("kind").agg(F.count("*").alias("n"))
    return per_kind.join(pairs.agg(F.count_distinct("format").alias("n")), "n").select("kind")


@query("ledger_reconcile", f"WITH v AS ({_VERDICT}), s AS (SELECT run_id, CAST(sum(micros) AS BIGINT) AS micros, count(*) FILTER (WHERE micros IS NULL) AS unmeasured FROM v GROUP BY run_id) SELECT r.run_id, r.spend_micros, s.micros, coalesce(s.unmeasured, 0) AS unmeasured, s.micros = r.spend_micros AS balanced FROM eval_run r LEFT JOIN s USING (run_id)")
def ledger_reconcile(spark, d):
    spent = verdicts(spark, d).groupBy("run_id").agg(F.sum("micros").alias("micros"), F.count_if(F.col("micros").isNull()).alias("unmeasured"))
    runs = table(spark, d, "eval_run").select("run_id", "spend_micros")
    return runs.join(spent, "run_id", "left").select("run_id", "spend_micros", "micros", F.coalesce("unmeasured", F.lit(0).cast("bigint")).alias("unmeasured"), (F.col("micros") == F.col("spend_micros")).alias("balanced"))


# Windows


@query("size_sweep", "SELECT doc_ord, source_bytes, running FROM (SELECT doc_ord, source_bytes, CAST(sum(source_bytes) OVER (PARTITION BY format ORDER BY indexed_at DESC, doc_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM doc) WHERE running > 50000000")
def size_sweep(spark, d):
    """Least recently used beyond a size bound, per format."""
    order = Window.partitionBy("format").orderBy(F.desc("indexed_at"), "doc_ord").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "doc").withColumn("running", F.sum("source_bytes").over(order)).where("running > 50000000").select("doc_ord", "source_bytes", "running")


@query("cap_per_doc", f"SELECT doc_ord, block_id FROM (SELECT doc_ord, block_id, row_number() OVER (PARTITION BY doc_ord ORDER BY page, ord, block_id) AS r FROM ({_HEAD}) WHERE kind = 'paragraph') WHERE r <= 3")
def cap_per_doc(spark, d):
    order = Window.partitionBy("doc_ord").orderBy("page", "ord", "block_id")
    return head(spark, d, "kind = 'paragraph'").select("doc_ord", "block_id", F.row_number().over(order).alias("r")).where("r <= 3").select("doc_ord", "block_id")


@query("pack_chars", f"SELECT doc_ord, block_id FROM (SELECT doc_ord, block_id, sum(length(text)) OVER (PARTITION BY doc_ord ORDER BY page, ord, block_id ROWS UNBOUNDED PRECEDING) AS c FROM ({_HEAD}) WHERE text IS NOT NULL) WHERE c <= 1200")
def pack_chars(spark, d):
    """The prefix of each document's blocks that fits a budget of characters."""
    order = Window.partitionBy("doc_ord").orderBy("page", "ord", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = head(spark, d, "text IS NOT NULL").select("doc_ord", "page", "ord", "block_id", F.char_length("text").alias("chars"))
    return rows.withColumn("c", F.sum("chars").over(order)).where("c <= 1200").select("doc_ord", "block_id")


@query("view_offsets", f"WITH m AS (SELECT segment_id, unnest(member_ids) AS block_id, generate_subscripts(member_ids, 1) AS i FROM segment), b AS (SELECT block_id, coalesce(length(text), 0) AS chars FROM ({_HEAD})) SELECT segment_id, block_id, CAST(coalesce(sum(chars + 1) OVER (PARTITION BY segment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM m JOIN b USING (block_id)")
def view_offsets(spark, d):
    """Where each member's text begins in its segment's view."""
    members = table(spark, d, "segment").select("segment_id", F.posexplode("member_ids").alias("i", "block_id"))
    sizes = head(spark, d).select("block_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("chars"))
    before = Window.partitionBy("segment_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return members.join(sizes, "block_id").select("segment_id", "block_id", F.coalesce(F.sum(F.col("chars") + 1).over(before), F.lit(0).cast("bigint")).alias("start"))


@query("latest_run", "SELECT suite, subject, arg_max(run_id, (started_ns, run_id)) AS run_id FROM eval_run GROUP BY suite, subject")
def latest_run(spark, d):
    return table(spark, d, "eval_run").groupBy("suite", "subject").agg(F.max_by("run_id", F.struct("started_ns", "run_id")).alias("run_id"))


@query(
    "rolling_breach",
    """WITH w AS (SELECT suite, run_id, started_ns, list_sort(list(spend_micros) OVER (PARTITION BY suite, subject ORDER BY started_ns, run_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) AS l, subject FROM eval_run),
       m AS (SELECT *, l[CAST(ceil(len(l) * 0.5) AS INTEGER)] AS median FROM w),
       b AS (SELECT *, CAST(len(l) = 7 AND median > 1.25 * first_value(median) OVER (PARTITION BY suite, subject ORDER BY len(l) < 7, started_ns, run_id) AS INTEGER) AS over FROM m)
       SELECT suite, subject, run_id FROM (SELECT *, sum(over) OVER (PARTITION BY suite, subject ORDER BY started_ns, run_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM b) WHERE s = 3""",
)
def rolling_breach(spark, d):
    """Runs that end three consecutive breaches: the median of a subject's last seven runs over one and a quarter of its first such median."""
    order = Window.partitionBy("suite", "subject").orderBy("started_ns", "run_id")
    values = F.sort_array(F.collect_list("spend_micros").over(order.rowsBetween(-6, 0)))
    rows = table(spark, d, "eval_run").select("suite", "subject", "run_id", "started_ns", values.alias("l"))
    rows = rows.withColumn("median", F.get("l", (F.ceil(F.size("l") * 0.5) - 1).cast("int")))
    base = F.first(F.when(F.size("l") == 7, F.col("median")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    over = rows.withColumn("over", ((F.size("l") == 7) & (F.col("median") > 1.25 * base)).cast("int"))
    return over.withColumn("s", F.sum("over").over(order.rowsBetween(-2, 0))).where("s = 3").select("suite", "subject", "run_id")


@query("flake_window", f"WITH v AS ({_VERDICT}), l AS (SELECT max(started_ns) AS last FROM eval_run), x AS (SELECT v.evaluator, v.assertion_id, count(*) AS n, count(*) FILTER (WHERE passed = 1) AS p FROM v JOIN eval_run r USING (run_id), l WHERE r.started_ns > l.last - 30 * 86400000000000 GROUP BY ALL) SELECT evaluator, count(*) AS assertions, count(*) FILTER (WHERE p > 0 AND p < n) AS flaky, count(*) FILTER (WHERE p > 0 AND p < n) > 0.02 * count(*) AS over FROM x GROUP BY evaluator")
def flake_window(spark, d):
    """Per evaluator, the assertions that both passed and failed within the thirty days up to the last run, and whether they are over two in a hundred."""
    runs = table(spark, d, "eval_run").select("run_id", "started_ns")
    last = runs.agg(F.max("started_ns").alias("last"))  # one row
    recent = runs.join(F.broadcast(last), F.col("started_ns") > F.col("last") - 30 * 86_400_000_000_000).select("run_id")
    per = verdicts(spark, d).join(recent, "run_id").groupBy("evaluator", "assertion_id").agg(F.count("*").alias("n"), F.count_if(F.col("passed") == 1).alias("p"))
    flaky = F.count_if((F.col("p") > 0) & (F.col("p") < F.col("n")))
    return per.groupBy("evaluator").agg(F.count("*").alias("assertions"), flaky.alias("flaky"), (flaky > 0.02 * F.count("*")).alias("over"))


@query("nearest_rank_pages", "SELECT format, l[CAST(ceil(len(l) * 0.5) AS INTEGER)] AS p50, l[CAST(ceil(len(l) * 0.9) AS INTEGER)] AS p90 FROM (SELECT format, list_sort(list(page_count)) AS l FROM doc WHERE page_count IS NOT NULL GROUP BY format)")
def nearest_rank_pages(spark, d):
    return stats.nearest_ranks(table(spark, d, "doc"), "format", "page_count", {"p50": 0.5, "p90": 0.9})


@query("first_last_page_block", f"SELECT doc_ord, page, arg_min(block_id, (ord, block_id)) AS first_block, arg_max(block_id, (ord, block_id)) AS last_block FROM ({_HEAD}) GROUP BY ALL")
def first_last_page_block(spark, d):
    at = F.struct("ord", "block_id")
    return head(spark, d).groupBy("doc_ord", "page").agg(F.min_by("block_id", at).alias("first_block"), F.max_by("block_id", at).alias("last_block"))


# Set operations


@query("undirected_pairs", f"WITH e AS (SELECT block_id AS a, parent_id AS b FROM ({_HEAD}) WHERE parent_id IS NOT NULL) SELECT a, b FROM e UNION SELECT b, a FROM e")
def undirected_pairs(spark, d):
    e = head(spark, d, "parent_id IS NOT NULL").select(F.col("block_id").alias("a"), F.col("parent_id").alias("b"))
    return e.union(e.select("b", "a")).distinct()


@query("generation_diff", "WITH n AS (SELECT DISTINCT doc_ord, content_digest FROM block WHERE state = 0), o AS (SELECT DISTINCT doc_ord, content_digest FROM block WHERE state = 1) SELECT coalesce(n.doc_ord, o.doc_ord) AS doc_ord, coalesce(n.content_digest, o.content_digest) AS content_digest, CASE WHEN o.doc_ord IS NULL THEN 'created' WHEN n.doc_ord IS NULL THEN 'retired' ELSE 'carried' END AS change FROM n FULL JOIN o ON n.doc_ord = o.doc_ord AND n.content_digest = o.content_digest")
def generation_diff(spark, d):
    """What the head generation of a document carried over, created and retired."""
    b = table(spark, d, "block").select("doc_ord", "content_digest", "state")
    marks = b.groupBy("doc_ord", "content_digest").agg(F.bool_or(F.col("state") == 0).alias("new"), F.bool_or(F.col("state") == 1).alias("old"))
    return marks.select("doc_ord", "content_digest", F.when(F.col("new") & F.col("old"), "carried").when(F.col("new"), "created").otherwise("retired").alias("change"))


@query("digests_in_both_layers", f"WITH h AS ({_HEAD}) SELECT content_digest FROM h WHERE method = 'native' INTERSECT SELECT content_digest FROM h WHERE method = 'native_xml'")
def digests_in_both_layers(spark, d):
    h = head(spark, d)
    return h.where("method = 'native'").select("content_digest").intersect(h.where("method = 'native_xml'").select("content_digest"))


@query("digests_only_native", f"WITH h AS ({_HEAD}) SELECT content_digest FROM h WHERE method = 'native' EXCEPT SELECT content_digest FROM h WHERE method <> 'native'")
def digests_only_native(spark, d):
    h = head(spark, d)
    return h.where("method = 'native'").select("content_digest").subtract(h.where("method <> 'native'").select("content_digest"))


# Evaluation


@query("slice_rates", f"WITH r AS (SELECT slice_key, count(*) AS n, CAST(sum(passed) AS BIGINT) AS k FROM ({_VERDICT}) GROUP BY slice_key), p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM r) SELECT slice_key, n, k, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high FROM p")
def slice_rates(spark, d):
    r = verdicts(spark, d).groupBy("slice_key").agg(F.count("*").alias("n"), F.sum("passed").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return r.select("slice_key", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("macro_mean", f"WITH r AS (SELECT slice_key, count(*) AS n, avg(passed) AS m FROM ({_VERDICT}) GROUP BY slice_key) SELECT count(*) AS slices, round(avg(m), 9) AS mean, round(sqrt(sum(m * (1 - m) / (n - 1))) / count(*), 9) AS se FROM r WHERE n >= 30")
def macro_mean(spark, d):
    """The mean over slices of at least thirty verdicts, each slice counting once, with its standard error."""
    r = verdicts(spark, d).groupBy("slice_key").agg(F.count("*").alias("n"), F.avg("passed").alias("m")).where("n >= 30")
    return r.agg(F.count("*").alias("slices"), F.round(F.avg("m"), 9).alias("mean"), F.round(F.sqrt(F.sum(F.col("m") * (1 - F.col("m")) / (F.col("n") - 1))) / F.count("*"), 9).alias("se"))


@query(
    "trust_separation",
    f"""WITH h AS (SELECT quote AS level, count(*) AS n, count(*) FILTER (WHERE method IN ('native', 'native_xml')) AS k FROM ({_HEAD}) GROUP BY 1), o AS (SELECT *, k / n AS p, lag(k / n) OVER (ORDER BY level) AS before FROM h)
        SELECT CASE WHEN min(n) < 30 THEN 'unknown' WHEN count(*) FILTER (WHERE before IS NOT NULL AND p <= before) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM o""",
)
def trust_separation(spark, d):
    """Whether the share of native text rises strictly with the quote level; a handful of levels."""
    levels = head(spark, d).groupBy(F.col("quote").alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("method").isin("native", "native_xml")).alias("k"))
    o = levels.withColumn("p", F.col("k") / F.col("n")).withColumn("before", F.lag("p").over(Window.orderBy("level")))
    return o.agg(F.when(F.min("n") < 30, "unknown").when(F.count_if(F.col("before").isNotNull() & (F.col("p") <= F.col("before"))) > 0, "fail").otherwise("pass").alias("verdict"))


@query(
    "calibration",
    f"""WITH v AS (SELECT score, passed, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin FROM ({_VERDICT}) WHERE score IS NOT NULL), b AS (SELECT bin, count(*) AS n, avg(score) AS s, avg(passed) AS p FROM v GROUP BY bin)
        SELECT round(sum(n * abs(s - p)) / sum(n), 9) AS ece, (SELECT round(avg((score - passed) * (score - passed)), 9) FROM v) AS brier FROM b""",
)
def calibration(spark, d):
    """Expected calibration error over ten bins, and the Brier score: bins carry the sums of both."""
    v = verdicts(spark, d).where("score IS NOT NULL").withColumn("bin", F.least(F.floor(F.col("score") * 10), F.lit(9)))
    b = v.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("passed").alias("p"), F.sum((F.col("score") - F.col("passed")) ** 2).alias("q"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("s") - F.col("p"))) / F.sum("n"), 9).alias("ece"), F.round(F.sum("q") / F.sum("n"), 9).alias("brier"))


@query(
    "scoreboard",
    f"""WITH v AS ({_VERDICT}), x AS (SELECT r.subject, count(*) AS n, avg(v.passed) AS rate, count(*) FILTER (WHERE r.unpinned > 0) AS unpinned FROM v JOIN eval_run r USING (run_id) GROUP BY r.subject)
        SELECT subject, n, round(rate, 9) AS rate, CASE WHEN n < 30 THEN 'UNKNOWN' WHEN unpinned > 0 THEN 'WITHHELD' WHEN rate < 0.5 THEN 'UNRANKED' ELSE 'RANKED' END AS state FROM x""",
)
def scoreboard(spark, d):
    runs = table(spark, d, "eval_run").select("run_id", "subject", "unpinned")
    x = verdicts(spark, d).join(runs, "run_id").groupBy("subject").agg(F.count("*").alias("n"), F.avg("passed").alias("rate"), F.count_if(F.col("unpinned") > 0).alias("unpinned"))
    return x.select("subject", "n", F.round("rate", 9).alias("rate"), F.when(F.col("n") < 30, "UNKNOWN").when(F.col("unpinned") > 0, "WITHHELD").when(F.col("rate") < 0.5, "UNRANKED").otherwise("RANKED").alias("state"))


@query("release_check", "WITH l AS (SELECT suite, subject, arg_max(status, (started_ns, run_id)) AS status FROM eval_run GROUP BY ALL) SELECT suite, count(*) AS subjects, count(*) FILTER (WHERE status <> 'ok') AS unsettled, count(*) FILTER (WHERE status <> 'ok') = 0 AS releasable FROM l GROUP BY suite")
def release_check(spark, d):
    latest = table(spark, d, "eval_run").groupBy("suite", "subject").agg(F.max_by("status", F.struct("started_ns", "run_id")).alias("status"))
    bad = F.count_if(F.col("status") != "ok")
    return latest.groupBy("suite").agg(F.count("*").alias("subjects"), bad.alias("unsettled"), (bad == 0).alias("releasable"))


@query("paired_sign_flip")
def paired_sign_flip(spark, d):
    """Per slice, whether the two evaluators pass the same assertions at the same rate."""
    v = verdicts(spark, d)
    of = lambda e: F.avg(F.when(F.col("evaluator") == e, F.col("passed")))
    both = v.groupBy("assertion_id", "slice_key").agg(of("text").alias("a"), of("owdoc").alias("b"))
    return stats.sign_flip(both.select("slice_key", (F.col("a") - F.col("b")).alias("diff")), "slice_key", "diff")


@query("threshold_fit")
def threshold_fit(spark, d):
    """The pass rate of each slice as a non-decreasing function of the score, fitted over every distinct score."""
    v = verdicts(spark, d).where("score IS NOT NULL").select("slice_key", "score", F.col("passed").cast("double").alias("passed"))
    return stats.isotonic(v, "slice_key", "score", "passed")


@query("assertion_quarantine", "SELECT type, count(*) AS n, count(*) FILTER (WHERE NOT json_valid(spec)) AS quarantined FROM (SELECT DISTINCT assertion_id, type, spec FROM eval_assertion) GROUP BY type")
def assertion_quarantine(spark, d):
    """Records whose JSON does not parse are counted beside the good ones."""
    a = table(spark, d, "eval_assertion").select("assertion_id", "type", "spec").distinct()
    return a.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.expr("try_parse_json(spec)").isNull() & F.col("spec").isNotNull()).alias("quarantined"))


@query("assertion_slices", "SELECT s.slice, count(DISTINCT a.assertion_id) AS n FROM eval_assertion a, (SELECT DISTINCT assertion_id, unnest(from_json(slices, '[\"VARCHAR\"]')) AS slice FROM eval_assertion WHERE json_valid(slices)) s WHERE s.assertion_id = a.assertion_id GROUP BY s.slice")
def assertion_slices(spark, d):
    a = table(spark, d, "eval_assertion").select("assertion_id", F.explode(F.from_json("slices", "array<string>")).alias("slice"))
    return a.groupBy("slice").agg(F.count_distinct("assertion_id").alias("n"))
