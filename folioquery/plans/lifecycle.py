"""Queries over the life of documents and derivations: ancestry, generations, carry-over, merges across runs, manifests, maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import derive, graph
from ..session import table
from .catalog import query
from .reports import _HEAD, _VERDICT, head, verdicts

@query("climb", f"WITH RECURSIVE h AS ({_HEAD}), c AS (SELECT block_id, parent_id AS ancestor, 1 AS up FROM h WHERE parent_id IS NOT NULL UNION ALL SELECT c.block_id, h.parent_id, up + 1 FROM c JOIN h ON h.block_id = c.ancestor WHERE h.parent_id IS NOT NULL) SELECT block_id, ancestor, up FROM c")
def climb(spark, d):
    """Every ancestor of every block with its distance: the descent along reversed edges."""
    up = head(spark, d, "parent_id IS NOT NULL").select(F.col("block_id").alias("parent"), F.col("parent_id").alias("child"))
    found = graph.descend(up, up.select(F.col("parent").alias("root")).distinct())
    return found.where("depth > 0").select(F.col("root").alias("block_id"), F.col("node").alias("ancestor"), F.col("depth").alias("up"))


@query("supersession", "WITH b AS (SELECT DISTINCT block_id, doc_ord, addr, gen, content_digest FROM block) SELECT o.block_id, n.block_id AS successor, o.content_digest = n.content_digest AS same FROM b o JOIN b n ON n.doc_ord = o.doc_ord AND n.addr = o.addr AND n.gen = o.gen + 1")
def supersession(spark, d):
    """The block that takes a block's address in the next generation, and whether it says the same."""
    b = table(spark, d, "block").select("block_id", "doc_ord", "addr", "gen", "content_digest").distinct()
    later = b.select("doc_ord", "addr", (F.col("gen") - 1).alias("gen"), F.col("block_id").alias("successor"), F.col("content_digest").alias("now"))
    return b.join(later, ["doc_ord", "addr", "gen"]).select("block_id", "successor", (F.col("content_digest") == F.col("now")).alias("same"))


@query("segment_carry", "WITH o AS (SELECT content_digest, min(segment_id) AS old_id FROM segment WHERE state = 1 GROUP BY content_digest) SELECT s.segment_id, coalesce(o.old_id, s.segment_id) AS kept_id, o.old_id IS NOT NULL AS carried FROM segment s LEFT JOIN o USING (content_digest) WHERE s.state = 0")
def segment_carry(spark, d):
    """Live segments keep the number of a retired one with the same digest."""
    s = table(spark, d, "segment")
    old = s.where("state = 1").groupBy("content_digest").agg(F.min("segment_id").alias("old_id"))
    return s.where("state = 0").join(old, "content_digest", "left").select("segment_id", F.coalesce("old_id", "segment_id").alias("kept_id"), F.col("old_id").isNotNull().alias("carried"))


@query("page_quotes", f"WITH m AS (SELECT segment_id, unnest(member_ids) AS block_id FROM segment WHERE state = 0) SELECT h.doc_ord, h.page, count(DISTINCT segment_id) AS segments, bit_or(h.restriction_bits) AS restrictions FROM m JOIN ({_HEAD}) h USING (block_id) GROUP BY ALL")
def page_quotes(spark, d):
    """How many live segments quote each page, and under which restrictions."""
    members = table(spark, d, "segment").where("state = 0").select("segment_id", F.explode("member_ids").alias("block_id"))
    rows = members.join(head(spark, d).select("block_id", "doc_ord", "page", "restriction_bits"), "block_id")
    return rows.groupBy("doc_ord", "page").agg(F.count_distinct("segment_id").alias("segments"), F.bit_or("restriction_bits").alias("restrictions"))


@query("cite_resolution", f"SELECT DISTINCT a.assertion_id, h.block_id, h.cite FROM eval_assertion a JOIN doc d ON d.uri = a.doc JOIN ({_HEAD}) h ON h.doc_ord = d.doc_ord AND h.addr = a.addr")
def cite_resolution(spark, d):
    """Addresses that assertions name, resolved in one batch to the blocks of the head generation."""
    a = table(spark, d, "eval_assertion").where("addr IS NOT NULL").select("assertion_id", F.col("doc").alias("uri"), "addr").distinct()
    docs = table(spark, d, "doc").select("doc_ord", "uri")
    return a.join(docs, "uri").join(head(spark, d).select("doc_ord", "addr", "block_id", "cite"), ["doc_ord", "addr"]).select("assertion_id", "block_id", "cite")


@query("scope_pages", f"SELECT h.block_id FROM ({_HEAD}) h JOIN doc d USING (doc_ord) WHERE (regexp_matches(d.uri, '^corpora/.*\\.pdf$') AND h.page BETWEEN 2 AND 5) OR h.doc_ord = 7")
def scope_pages(spark, d):
    """Blocks in the scopes `corpora/**.pdf#p2-5` and `d7`."""
    from .records import scope_condition

    rows = head(spark, d).select("block_id", "doc_ord", "page").join(table(spark, d, "doc").select("doc_ord", "uri"), "doc_ord")
    return rows.where(scope_condition("corpora/**.pdf#p2-5") | scope_condition("d7")).select("block_id")


@query("narrowing", f"WITH h AS ({_HEAD}), f(name, kinds, p) AS (VALUES ('all', NULL, -1), ('headings', 'heading', -1), ('far', NULL, 1000000)), n AS (SELECT f.name, count(*) FILTER (WHERE (f.kinds IS NULL OR h.kind = f.kinds) AND h.page >= f.p) AS blocks, f.kinds IS NULL AND f.p < 0 AS open FROM f, h GROUP BY ALL) SELECT name, blocks, CASE WHEN open THEN 'all' WHEN blocks = 0 THEN 'empty' ELSE 'set' END AS tag FROM n")
def narrowing(spark, d):
    """What a filter leaves, tagged: everything (no condition), a set, or nothing."""
    tests = {"all": F.lit(True), "headings": F.col("kind") == "heading", "far": F.col("page") >= 1_000_000}
    counted = head(spark, d).agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    rows = counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("blocks")) for n in tests])))
    return rows.withColumn("tag", F.when(F.col("name") == "all", "all").when(F.col("blocks") == 0, "empty").otherwise("set"))


@query("over_fetch", f"WITH h AS ({_HEAD}), t AS (SELECT count(*) AS live FROM h) SELECT kind, count(*) AS n, CAST(least(64, greatest(1, ceil(live / count(*)))) AS BIGINT) AS factor FROM h, t GROUP BY kind, live")
def over_fetch(spark, d):
    """How many times more rows a search fetches before it filters by a kind: live blocks over those of the kind, from 1 to 64."""
    n = head(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    live = n.agg(F.sum("n").alias("live"))  # one row
    return n.join(F.broadcast(live), F.lit(True)).select("kind", "n", F.least(F.lit(64), F.greatest(F.lit(1), F.ceil(F.col("live") / F.col("n")))).alias("factor"))


@query("manifest_tallies", f"SELECT d.format, h.method, count(*) AS blocks, count(*) FILTER (WHERE h.trust = 0) AS ambiguous, count(*) FILTER (WHERE h.quote < 3) AS unquotable, count(DISTINCT h.doc_ord) FILTER (WHERE d.status = 'partial') AS partial_docs FROM ({_HEAD}) h JOIN doc d USING (doc_ord) GROUP BY ALL")
def manifest_tallies(spark, d):
    """The degradation of each format and method: what is ambiguous, may not be quoted, or stands in partial documents."""
    rows = head(spark, d).select("doc_ord", "method", "trust", "quote").join(table(spark, d, "doc").select("doc_ord", "format", "status"), "doc_ord")
    # Documents first: the second step counts a row a document.
    per_doc = rows.groupBy("format", "method", "doc_ord", "status").agg(F.count("*").alias("b"), F.count_if(F.col("trust") == 0).alias("a"), F.count_if(F.col("quote") < 3).alias("u"))
    return per_doc.groupBy("format", "method").agg(F.sum("b").alias("blocks"), F.sum("a").alias("ambiguous"), F.sum("u").alias("unquotable"), F.count_if(F.col("status") == "partial").alias("partial_docs"))


@query("overloaded_names", f"WITH h AS ({_HEAD}), e AS (SELECT lower(text) AS name, block_id, doc_ord FROM h WHERE kind IN ('heading', 'title') AND text <> '') SELECT name, count(*) AS sites, count(DISTINCT doc_ord) AS docs, count(*) > 4096 AND count(DISTINCT doc_ord) <= 1 AS overloaded FROM e GROUP BY name")
def overloaded_names(spark, d):
    """Names with more than 4,096 places of their own in one document at most: they are kept out of resolution and communities."""
    e = head(spark, d, "kind IN ('heading', 'title') AND text <> ''").select(F.lower("text").alias("name"), "doc_ord")
    per_doc = e.groupBy("name", "doc_ord").agg(F.count("*").alias("n"))
    out = per_doc.groupBy("name").agg(F.sum("n").alias("sites"), F.count("*").alias("docs"))
    return out.withColumn("overloaded", (F.col("sites") > 4096) & (F.col("docs") <= 1))


_DOCTOR = [("unresolved", 0.35), ("quarantined", 80.0), ("ungrounded", 0.15), ("cover_empty", 0.98)]


@query(
    "graph_doctor",
    f"""WITH h AS ({_HEAD}), s AS (SELECT count(*) FILTER (WHERE segment_digest IS NULL) / count(*) AS x FROM (SELECT DISTINCT s.segment_id, p.segment_digest FROM segment s LEFT JOIN vpending p ON p.segment_digest = s.content_digest WHERE s.state = 0)),
        m AS (SELECT 'unresolved' AS measure, count(*) FILTER (WHERE page_count IS NULL) / count(*) AS value, 0.35 AS most FROM doc UNION ALL
              SELECT 'quarantined', CAST(count(*) FILTER (WHERE NOT json_valid(spec)) AS DOUBLE), 80.0 FROM (SELECT DISTINCT assertion_id, spec FROM eval_assertion) UNION ALL
              SELECT 'ungrounded', count(*) FILTER (WHERE quote < 3) / count(*), 0.15 FROM h UNION ALL SELECT 'cover_empty', x, 0.98 FROM s)
        SELECT measure, round(value, 9) AS value, value > most AS over FROM m""",
)
def graph_doctor(spark, d):
    """Four health measures of the derived data against their bounds."""
    ratio = lambda c: F.count_if(c) / F.count("*")
    docs = table(spark, d, "doc").agg(ratio(F.col("page_count").isNull()).alias("value"))
    spec = table(spark, d, "eval_assertion").select("assertion_id", "spec").distinct().agg(F.count_if(F.expr("try_parse_json(spec)").isNull()).cast("double").alias("value"))
    blocks = head(spark, d).agg(ratio(F.col("quote") < 3).alias("value"))
    waiting = table(spark, d, "vpending").select(F.col("segment_digest").alias("content_digest")).distinct().withColumn("hit", F.lit(1))
    cover = table(spark, d, "segment").where("state = 0").select("content_digest").join(waiting, "content_digest", "left").agg(ratio(F.col("hit").isNull()).alias("value"))
    out = None
    for (name, most), df in zip(_DOCTOR, (docs, spec, blocks, cover)):
        row = df.select(F.lit(name).alias("measure"), F.round("value", 9).alias("value"), (F.col("value") > most).alias("over"))
        out = row if out is None else out.unionByName(row)
    return out


@query("replaced_runs", "SELECT run_id, suite, subject, row_number() OVER (PARTITION BY suite, subject, corpus_id ORDER BY started_ns DESC, run_id DESC) > 1 AS retired FROM eval_run")
def replaced_runs(spark, d):
    """A newer run of a suite on a subject and corpus retires the older ones: an aggregate and a join, no group in one task."""
    r = table(spark, d, "eval_run").select("run_id", "suite", "subject", "corpus_id", "started_ns")
    newest = r.groupBy("suite", "subject", "corpus_id").agg(F.max_by("run_id", F.struct("started_ns", "run_id")).alias("newest"))
    return r.join(newest, ["suite", "subject", "corpus_id"]).select("run_id", "suite", "subject", (F.col("run_id") != F.col("newest")).alias("retired"))


_GROUPS = "SELECT DISTINCT lower(text) AS name, doc_ord FROM block WHERE kind IN ('heading', 'title') AND text <> '' AND state = {}"


@query(
    "community_match",
    f"""WITH n AS ({_GROUPS.format(0)}), o AS ({_GROUPS.format(1)}), m AS (SELECT n.name, o.name AS was, count(*) AS shared FROM n JOIN o ON o.doc_ord = n.doc_ord GROUP BY ALL),
        b AS (SELECT name, was, shared FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY was <> name, shared DESC, was) AS r FROM m) WHERE r = 1)
        SELECT g.name, CASE WHEN b.was = g.name THEN 'carried' WHEN b.was IS NOT NULL THEN 'overlap' ELSE 'new' END AS how, coalesce(b.was, g.name) AS matched FROM (SELECT DISTINCT name FROM n) g LEFT JOIN b USING (name)""",
)
def community_match(spark, d):
    """Groups of documents of the live generation matched to those of the retired one: by name, then by the largest overlap, else new."""
    b = table(spark, d, "block").where("kind IN ('heading', 'title') AND text <> ''").select(F.lower("text").alias("name"), "doc_ord", "state").distinct()
    now, old = b.where("state = 0").select("name", "doc_ord"), b.where("state = 1").select(F.col("name").alias("was"), "doc_ord")
    shared = now.join(old, "doc_ord").groupBy("name", "was").agg(F.count("*").alias("shared"))
    best = shared.groupBy("name").agg(F.min_by("was", F.struct((F.col("was") != F.col("name")).alias("o"), (-F.col("shared")).alias("s"), "was")).alias("was"))
    how = F.when(F.col("was") == F.col("name"), "carried").when(F.col("was").isNotNull(), "overlap").otherwise("new")
    return now.select("name").distinct().join(best, "name", "left").select("name", how.alias("how"), F.coalesce("was", "name").alias("matched"))


@query("report_context", f"WITH h AS ({_HEAD}), t AS (SELECT kind, block_id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens FROM h WHERE text <> '') SELECT kind, block_id FROM (SELECT *, sum(tokens) OVER (PARTITION BY kind ORDER BY tokens DESC, block_id ROWS UNBOUNDED PRECEDING) AS upto FROM t) WHERE upto <= 8000")
def report_context(spark, d):
    """Records for a report of each kind, the largest first, up to 8,000 tokens. A record has a token at least, so 8,000 rows a group decide."""
    t = head(spark, d, "text <> ''").select("kind", "block_id", text.token_cost(F.col("text")).alias("tokens"))
    order = Window.partitionBy("kind").orderBy(F.desc("tokens"), "block_id")
    few = t.withColumn("r", F.row_number().over(order)).where("r <= 8000")
    return few.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("upto <= 8000").select("kind", "block_id")


@query("residue_groups", f"WITH v AS ({_VERDICT}) SELECT evaluator, slice_key, count(*) AS n, count(DISTINCT assertion_id) AS assertions FROM v WHERE passed = 0 GROUP BY ALL HAVING count(*) >= 2")
def residue_groups(spark, d):
    """What is left to settle: failures grouped by evaluator and slice, those of two and more."""
    v = verdicts(spark, d).where("passed = 0").groupBy("evaluator", "slice_key", "assertion_id").agg(F.count("*").alias("k"))
    return v.groupBy("evaluator", "slice_key").agg(F.sum("k").alias("n"), F.count("*").alias("assertions")).where("n >= 2")


@query("counters", "WITH n AS (SELECT kind, count(DISTINCT block_id) FILTER (WHERE state = 0) AS now, count(DISTINCT block_id) FILTER (WHERE state = 1) AS was FROM block GROUP BY kind) SELECT kind, now, was, now <> was AS exact_fails, now > was * 1.1 AS ratchet_fails FROM n")
def counters(spark, d):
    """Counters of two generations: an exact one fails on any difference, a ratchet on a rise of over a tenth."""
    b = table(spark, d, "block").select("block_id", "kind", "state").distinct()
    n = b.groupBy("kind").agg(F.count_if(F.col("state") == 0).alias("now"), F.count_if(F.col("state") == 1).alias("was"))
    return n.select("kind", "now", "was", (F.col("now") != F.col("was")).alias("exact_fails"), (F.col("now") > F.col("was") * 1.1).alias("ratchet_fails"))


_NAMES = "SELECT DISTINCT lower(label) AS name FROM block WHERE label IS NOT NULL AND state = {}"


@query("portability", f"SELECT coalesce(n.name, o.name) AS name, CASE WHEN o.name IS NULL THEN 'found' WHEN n.name IS NULL THEN 'missing' ELSE 'kept' END AS status FROM ({_NAMES.format(0)}) n FULL JOIN ({_NAMES.format(1)}) o ON n.name = o.name")
def portability(spark, d):
    """Names of the retired generation against those found now."""
    b = table(spark, d, "block").where("label IS NOT NULL").select(F.lower("label").alias("name"), "state").groupBy("name").agg(F.bool_or(F.col("state") == 0).alias("n"), F.bool_or(F.col("state") == 1).alias("o"))
    return b.where("n OR o").select("name", F.when(~F.col("o"), "found").when(~F.col("n"), "missing").otherwise("kept").alias("status"))


@query("metric_rot", "WITH r AS (SELECT suite, subject, spend_micros, row_number() OVER (PARTITION BY suite, subject ORDER BY started_ns, run_id) AS i, count(*) OVER (PARTITION BY suite, subject) AS n FROM eval_run WHERE status = 'ok') SELECT suite, subject, count(*) AS runs, count(DISTINCT spend_micros) = 1 AND count(*) >= 3 AS rotten FROM r GROUP BY ALL")
def metric_rot(spark, d):
    """A metric that has not moved over three and more good runs measures nothing any more."""
    r = table(spark, d, "eval_run").where("status = 'ok'").groupBy("suite", "subject", "spend_micros").agg(F.count("*").alias("k"))
    n = r.groupBy("suite", "subject").agg(F.sum("k").alias("runs"), F.count("spend_micros").alias("values"))
    return n.select("suite", "subject", "runs", ((F.col("values") == 1) & (F.col("runs") >= 3)).alias("rotten"))


@query("audit_selection", f"WITH v AS ({_VERDICT}) SELECT run_id, assertion_id, evaluator FROM v WHERE CAST('0x' || substr(sha256(run_id || '/' || assertion_id || '/' || evaluator || '/audit'), 1, 8) AS BIGINT) % 100 < 5")
def audit_selection(spark, d):
    """Five in a hundred verdicts, chosen by a derived hash: the sampling operator of audits."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("/", "run_id", "assertion_id", "evaluator", F.lit("audit")), 256), 1, 8), 16, 10).cast("bigint")
    return table(spark, d, "eval_verdict").where(h % 100 < 5).select("run_id", "assertion_id", "evaluator").distinct()


@query("decision_ids", "SELECT doc_ord, sha256(concat_ws('|', doc_key, format, coalesce(media_type, '~'), CAST(source_bytes AS VARCHAR), CAST(gen AS VARCHAR), status, coalesce(CAST(page_count AS VARCHAR), '~'), model_version)) AS decision_id, concat_ws('/', format, coalesce(media_type, '~'), status) AS slice_key FROM doc")
def decision_ids(spark, d):
    """The identity of a routing decision over eight fields, and its slice, with ~ for what is unknown."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    fields = [known(c) for c in ("doc_key", "format", "media_type", "source_bytes", "gen", "status", "page_count", "model_version")]
    return table(spark, d, "doc").select("doc_ord", F.sha2(F.concat_ws("|", *fields), 256).alias("decision_id"), F.concat_ws("/", known("format"), known("media_type"), known("status")).alias("slice_key"))


#: A policy: name, condition, most expensive cost class allowed, lanes admitted, lanes denied, rendering.
MODIFIERS = [
    ("large", "source_bytes > 500000", 2, ["text", "table"], ["vision"], 1),
    ("paged", "format = 'pdf'", 3, ["text", "vision"], [], 2),
    ("partial", "status = 'partial'", 1, ["text"], ["llm"], 0),
    ("any", "true", 4, ["llm"], [], 0),
]
_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"


@query(
    "modifiers",
    "WITH m AS ("
    + " UNION ALL ".join(f"SELECT doc_ord, {c} AS cost, {_LIST(a)} AS admit, {_LIST(n)} AS deny, {r} AS render FROM doc WHERE {w}" for _, w, c, a, n, r in MODIFIERS)
    + "), g AS (SELECT doc_ord, min(cost) AS cost, flatten(list(admit)) AS a, flatten(list(deny)) AS n, max(render) AS render FROM m GROUP BY doc_ord) SELECT doc_ord, CAST(cost AS INTEGER) AS cost, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(n, x))), ',') AS lanes, CAST(render AS INTEGER) AS render FROM g",
)
def modifiers(spark, d):
    """All matching modifiers of a document as one: the least cost class, the lanes admitted less those denied, the dearest rendering."""
    doc = table(spark, d, "doc").select("doc_ord", "source_bytes", "format", "status")
    strings = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    parts = [(F.coalesce(F.expr(w), F.lit(False)), c, a, n, r) for _, w, c, a, n, r in MODIFIERS]
    cost = F.least(*[F.when(w, c) for w, c, *_ in parts])
    admit = F.concat(*[F.when(w, strings(a)).otherwise(strings([])) for w, _, a, _, _ in parts])
    deny = F.concat(*[F.when(w, strings(n)).otherwise(strings([])) for w, _, _, n, _ in parts])
    render = F.greatest(*[F.when(w, r) for w, _, _, _, r in parts])
    return doc.select("doc_ord", cost.alias("cost"), F.array_join(F.array_sort(F.array_except(F.array_distinct(admit), deny)), ",").alias("lanes"), render.alias("render"))


@query("rule_lint")
def rule_lint(spark, d):
    """Rules that an earlier, wider one keeps from ever being reached: over all documents, none that the later matches is missed by the earlier."""
    doc = table(spark, d, "doc").select("source_bytes", "format", "status")
    hit = {n: F.coalesce(F.expr(w), F.lit(False)) for n, w, *_ in MODIFIERS}
    names = list(hit)
    pairs = [(names[i], names[j]) for j in range(len(names)) for i in range(j)]
    counted = doc.agg(*[F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"), F.count_if(hit[b]).alias("matched"), F.count_if(hit[b] & ~hit[a]).alias("reached")).alias(f"{a}_{b}") for a, b in pairs])
    return counted.select(F.inline(F.array(*[f"{a}_{b}" for a, b in pairs]))).withColumn("shadowed", (F.col("matched") > 0) & (F.col("reached") == 0))


@query("egress_policy", f"WITH t(tier, denied) AS (VALUES ('public', 31), ('partner', 12), ('internal', 0)) SELECT tier, count(*) FILTER (WHERE h.restriction_bits & denied = 0) AS allowed, count(*) FILTER (WHERE h.restriction_bits & denied <> 0) AS withheld FROM t, ({_HEAD}) h GROUP BY tier")
def egress_policy(spark, d):
    """Blocks that may leave under each tier, by the restriction bits the tier denies: one pass for all tiers."""
    tiers = {"public": 31, "partner": 12, "internal": 0}
    free = lambda bits: F.col("restriction_bits").bitwiseAND(F.lit(bits).cast("bigint")) == 0
    n = head(spark, d).agg(*[F.struct(F.lit(t).alias("tier"), F.count_if(free(b)).alias("allowed"), F.count_if(~free(b)).alias("withheld")).alias(t) for t, b in tiers.items()])
    return n.select(F.inline(F.array(*tiers)))


@query("exact_channel", f"WITH h AS ({_HEAD}), a AS (SELECT block_id, regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\.?\\s', 1) AS name FROM h WHERE kind IN ('heading', 'title') AND text IS NOT NULL), r AS (SELECT DISTINCT block_id AS query_id, unnest(regexp_extract_all(text, '{derive.REFERENCES['section']}', 1)) AS name FROM h WHERE block_id % 20 = 0 AND text IS NOT NULL) SELECT query_id, a.block_id FROM r JOIN a USING (name) WHERE name <> ''")
def exact_channel(spark, d):
    """What every twentieth block's references name exactly, in the whole corpus."""
    h = head(spark, d)
    refs = derive.references(h.where("block_id % 20 = 0"))
    return derive.resolve_references(refs, derive.anchors(h), corpus_scope=True).select(F.col("block_id").alias("query_id"), F.col("target").alias("block_id")).distinct()


@query("doc_handle", f"SELECT h.block_id, h.page, h.kind FROM ({_HEAD}) h WHERE doc_ord = 2 AND page BETWEEN 0 AND 3 AND layer = 'body' AND kind IN ('paragraph', 'heading')")
def doc_handle(spark, d):
    """Reads through a document's handle: pages, kinds and layers."""
    from ..sdk import corpus

    return corpus(spark, d).doc(2).blocks(pages=(0, 3), kinds=("paragraph", "heading"), layers=("body",)).select("block_id", "page", "kind")


@query("run_clock", f"WITH v AS (SELECT run_id, CAST(sum(wall_ms) AS BIGINT) AS mono_ms FROM ({_VERDICT}) GROUP BY run_id) SELECT r.run_id, abs((ended_ns - started_ns) // 1000000 - mono_ms) > 1 AS stepped, CASE WHEN abs((ended_ns - started_ns) // 1000000 - mono_ms) > 1 THEN started_ns + mono_ms * 1000000 ELSE ended_ns END AS ends FROM eval_run r JOIN v USING (run_id) WHERE ended_ns IS NOT NULL")
def run_clock(spark, d):
    """Runs whose wall clock and measured time differ by over a millisecond end by the measured time."""
    v = verdicts(spark, d).groupBy("run_id").agg(F.sum("wall_ms").alias("mono_ms"))
    r = table(spark, d, "eval_run").where("ended_ns IS NOT NULL").select("run_id", "started_ns", "ended_ns").join(v, "run_id")
    stepped = F.abs(F.expr("(ended_ns - started_ns) div 1000000") - F.col("mono_ms")) > 1
    return r.select("run_id", stepped.alias("stepped"), F.when(stepped, F.col("started_ns") + F.col("mono_ms") * 1_000_000).otherwise(F.col("ended_ns")).alias("ends"))


@query("trace_stat", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def trace_stat(spark, d):
    per = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type", "user_id").agg(F.count("*").alias("k"))
    return per.groupBy("day", "event_type").agg(F.sum("k").alias("n"), F.count("user_id").alias("users"))


@query("trace_prune", "SELECT event_id FROM events, (SELECT max(ts) AS last FROM events) WHERE ts >= last - INTERVAL 7 DAY")
def trace_prune(spark, d):
    """What an age prune of seven days before the last event keeps."""
    e = table(spark, d, "events").select("event_id", "ts")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("last"))), F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).select("event_id")


@query("absence_gates", f"""WITH h AS (SELECT d.format, h.* FROM ({_HEAD}) h JOIN doc d USING (doc_ord)), f AS (SELECT format, count(*) FILTER (WHERE status <> 'ok') > 0 AS coverage_incomplete, count(*) FILTER (WHERE page_count IS NULL) > 0 AS parse_gap_in_scope, count(*) FILTER (WHERE indexed_at IS NULL) > 0 AS freshness_unknown FROM doc GROUP BY format),
    b AS (SELECT format, count(*) FILTER (WHERE restriction_bits <> 0) > 0 AS restricted_withheld, count(*) FILTER (WHERE kind = 'caption') = 0 AS filter_starved, sum(length(text)) FILTER (WHERE kind = 'caption') > 4000 AS truncated_by_packing, count(*) FILTER (WHERE kind = 'caption') AS hits FROM h GROUP BY format),
    p AS (SELECT DISTINCT d.format, true AS pending FROM vpending v JOIN segment s ON s.content_digest = v.segment_digest JOIN doc d USING (doc_ord)),
    x AS (SELECT f.format, coalesce(b.hits, 0) AS hits, list_filter([CASE WHEN coverage_incomplete THEN 'coverage_incomplete' END, CASE WHEN pending THEN 'pending_work_in_scope' END, CASE WHEN freshness_unknown THEN 'freshness_unknown' END, CASE WHEN parse_gap_in_scope THEN 'parse_gap_in_scope' END, CASE WHEN restricted_withheld THEN 'restricted_withheld' END, CASE WHEN filter_starved THEN 'filter_starved' END, CASE WHEN truncated_by_packing THEN 'truncated_by_packing' END], lambda c: c IS NOT NULL) AS c FROM f LEFT JOIN b USING (format) LEFT JOIN p USING (format))
    SELECT format, hits, array_to_string(c, ',') AS causes, CASE WHEN len(c) > 0 THEN 'degraded' WHEN hits > 0 THEN 'ok' ELSE 'absent' END AS state FROM x""")
def absence_gates(spark, d):
    """For a search of captions in each format: the facts that the tables hold, the gates they fail in their order, and the state of the answer."""
    from ..operators import retrieval

    doc = table(spark, d, "doc").select("doc_ord", "format", "status", "page_count", "indexed_at")
    some = lambda c: F.count_if(c) > 0
    facts = doc.groupBy("format").agg(some(F.col("status") != "ok").alias("coverage_incomplete"), some(F.col("page_count").isNull()).alias("parse_gap_in_scope"), some(F.col("indexed_at").isNull()).alias("freshness_unknown"))
    caption = F.col("kind") == "caption"
    blocks = head(spark, d).select("doc_ord", "kind", "restriction_bits", "text").join(doc.select("doc_ord", "format"), "doc_ord").groupBy("format").agg(some(F.col("restriction_bits") != 0).alias("restricted_withheld"), (F.count_if(caption) == 0).alias("filter_starved"), (F.sum(F.when(caption, F.char_length("text"))) > 4000).alias("truncated_by_packing"), F.count_if(caption).alias("hits"))
    waiting = table(spark, d, "vpending").select(F.col("segment_digest").alias("content_digest")).distinct()
    pending = table(spark, d, "segment").select("content_digest", "doc_ord").join(waiting, "content_digest").join(doc.select("doc_ord", "format"), "doc_ord").select("format").distinct().withColumn("pending_work_in_scope", F.lit(True))
    rows = facts.join(blocks, "format", "left").join(pending, "format", "left").na.fill(0, ["hits"])
    return retrieval.verdict(rows).select("format", "hits", F.array_join("causes", ",").alias("causes"), "state")


@query("evaluator_agreement")
def evaluator_agreement(spark, d):
    """How far the words of a block agree with those of the block at its address in the next generation."""
    from ..functions.similarity import agreement

    b = table(spark, d, "block").select("doc_ord", "addr", "gen", "block_id", "text").dropDuplicates(["doc_ord", "addr", "gen"])
    later = b.select("doc_ord", "addr", (F.col("gen") - 1).alias("gen"), F.col("text").alias("now"))
    return b.join(later, ["doc_ord", "addr", "gen"]).select("block_id", agreement("text", "now").alias("agreement"))
