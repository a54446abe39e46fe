"""Queries of the derivation, graph and text-function operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import derive, graph
from ..session import cut, table
from .catalog import query
from .reports import _HEAD, head

_TREE = f"h AS ({_HEAD}), e AS (SELECT parent_id AS parent, block_id AS child FROM h WHERE parent_id IS NOT NULL)"


@query("subtree", f"WITH RECURSIVE {_TREE}, r AS (SELECT block_id AS root, block_id AS node, 0 AS depth FROM h WHERE parent_id IS NULL UNION ALL SELECT r.root, e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.node) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL")
def subtree(spark, d):
    h = head(spark, d).select("block_id", "parent_id")
    edges = h.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("parent"), F.col("block_id").alias("child"))
    return graph.descend(edges, h.where("parent_id IS NULL").select(F.col("block_id").alias("root")))


@query("block_components", f"WITH RECURSIVE {_TREE}, u AS (SELECT parent AS a, child AS b FROM e UNION SELECT child, parent FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node) SELECT node, CAST(min(c) AS BIGINT) AS component FROM r GROUP BY node")
def block_components(spark, d):
    h = head(spark, d, "parent_id IS NOT NULL")
    return graph.components(h.select(F.col("parent_id").alias("a"), F.col("block_id").alias("b")))


@query("expand_beam")
def expand_beam(spark, d):
    """Two hops over parent links and reading order from the first block of each document."""
    h = head(spark, d)
    order = Window.partitionBy("doc_ord").orderBy("page", "ord", "block_id")
    nxt = h.select(F.col("block_id").alias("a"), F.lead("block_id").over(order).alias("b"), F.lit(0.6).alias("weight")).where("b IS NOT NULL")
    up = h.where("parent_id IS NOT NULL").select(F.col("block_id").alias("a"), F.col("parent_id").alias("b"), F.lit(0.9).alias("weight"))
    edges = nxt.unionByName(up)
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    seeds = h.groupBy(F.col("doc_ord").alias("query_id")).agg(F.min_by("block_id", F.struct("page", "ord", "block_id")).alias("node")).withColumn("score", F.lit(1.0))
    return graph.expand(edges, seeds)


def heading_keys(spark: SparkSession, d: str) -> DataFrame:
    """(node, key): each document with each heading key it shares with another one, however many share it."""
    titles = head(spark, d, "kind IN ('heading', 'title') AND text IS NOT NULL").select(F.col("doc_ord").alias("node"), text.normalize_key(F.regexp_replace("text", r"^[\d.]+\s+", "")).alias("key")).distinct()
    return titles.join(titles.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1").select("key"), "key").select("node", "key")


@query("doc_communities")
def doc_communities(spark, d):
    """Communities of documents that share heading keys."""
    return graph.communities(heading_keys(spark, d))


@query("community_cohesion")
def community_cohesion(spark, d):
    """How many pairs of documents of a community share a heading key."""
    keys = cut(heading_keys(spark, d))
    return graph.cohesion(keys, graph.communities(keys))


@query("salience", f"WITH e AS (SELECT block_id AS a, parent_id AS b FROM ({_HEAD}) WHERE parent_id IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT a AS node, count(*) AS degree FROM u WHERE a <> b GROUP BY a")
def salience(spark, d):
    return graph.salience(head(spark, d, "parent_id IS NOT NULL").select(F.col("block_id").alias("a"), F.col("parent_id").alias("b")))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return head(spark, d, "kind IN ('heading', 'title', 'section')").select(F.col("block_id").alias("id"), F.coalesce("text", "label").alias("label")).where("label IS NOT NULL")


@query("label_pairs")
def label_pairs(spark, d):
    """Headings that may be one name, with the decision for each."""
    return graph.fuzzy_pairs(labels(spark, d))


@query("label_closure")
def label_closure(spark, d):
    """Merged labels, with one veto for each ambiguous pair; pairs that other numbers keep apart are never met."""
    pairs = cut(graph.fuzzy_pairs(labels(spark, d), same_numbers=True).where("decision IN ('merge', 'ambiguous')"))
    return graph.closure(pairs.where("decision = 'merge'").select("a", "b", "score"), pairs.where("decision = 'ambiguous'").select("a", "b"))


@query("exact_name_pairs", "WITH n AS (SELECT p_partkey, p_name, min(p_partkey) OVER (PARTITION BY p_name) AS first FROM part) SELECT first AS a, p_partkey AS b FROM n WHERE p_partkey <> first")
def exact_name_pairs(spark, d):
    """Each member of a name pairs with the first, not with all."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    first = p.groupBy("p_name").agg(F.min("p_partkey").alias("a"))
    return p.join(first, "p_name").where("p_partkey <> a").select("a", F.col("p_partkey").alias("b"))


@query("nearest_heading", f"WITH h AS ({_HEAD}) SELECT block_id, last_value(CASE WHEN kind IN ('heading', 'title', 'section') THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_ord ORDER BY page, ord, block_id ROWS UNBOUNDED PRECEDING) AS heading_id FROM h")
def nearest_heading(spark, d):
    return derive.heading_path(head(spark, d)).select("block_id", "heading_id")


@query("segmenter")
def segmenter(spark, d):
    return derive.segments(head(spark, d))


def _patterns() -> str:
    return " UNION ".join(f"SELECT block_id, doc_ord, '{k}' AS akind, unnest(regexp_extract_all(text, '{p}', 1)) AS name FROM h WHERE text IS NOT NULL" for k, p in derive.REFERENCES.items())


_ANCHOR = r"SELECT block_id, doc_ord, 'section' AS akind, regexp_extract(text, '^(\d+(?:\.\d+)*)\.?\s', 1) AS name FROM h WHERE kind IN ('heading', 'title') AND text IS NOT NULL"


@query("references", f"WITH h AS ({_HEAD}) {_patterns()}")
def references(spark, d):
    return derive.references(head(spark, d))


@query("anchors", f"WITH h AS ({_HEAD}) SELECT * FROM ({_ANCHOR}) WHERE name <> ''")
def anchors(spark, d):
    return derive.anchors(head(spark, d))


@query("resolved_references", f"WITH h AS ({_HEAD}), r AS ({_patterns()}), a AS ({_ANCHOR}) SELECT r.block_id, r.akind, r.name, a.block_id AS target FROM r JOIN a ON a.akind = r.akind AND a.name = r.name AND a.name <> '' AND a.doc_ord = r.doc_ord")
def resolved_references(spark, d):
    h = head(spark, d)
    return derive.resolve_references(derive.references(h), derive.anchors(h))


@query("unresolved_by_name", f"WITH h AS ({_HEAD}), r AS ({_patterns()}), a AS ({_ANCHOR}) SELECT akind, name, count(*) AS sites, count(DISTINCT doc_ord) AS docs FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.akind = r.akind AND a.name = r.name AND a.doc_ord = r.doc_ord) GROUP BY ALL")
def unresolved_by_name(spark, d):
    h = head(spark, d)
    return derive.unresolved_references(derive.references(h), derive.anchors(h)).groupBy("akind", "name").agg(F.count("*").alias("sites"), F.count_distinct("doc_ord").alias("docs"))


_DEFINED = " UNION ".join(f"SELECT block_id, '{f}' AS form, unnest(regexp_extract_all(text, '{p}', {i})) AS term FROM h WHERE text IS NOT NULL" for f, p in derive.DEFINITIONS.items() for i in range(1, 5))


@query("defined_terms", f"WITH h AS ({_HEAD}) SELECT * FROM ({_DEFINED}) WHERE length(trim(regexp_replace(lower(term), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '_', 'g'), '_')) >= 3")
def defined_terms(spark, d):
    return derive.defined_terms(head(spark, d))


@query("lexicon", f"WITH h AS ({_HEAD}), m AS (SELECT doc_ord, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM h WHERE text IS NOT NULL), s AS (SELECT name, count(DISTINCT doc_ord) AS docs FROM m WHERE length(name) >= 4 GROUP BY name) SELECT name, docs FROM s WHERE NOT (docs >= 2 AND docs > (SELECT count(*) FROM doc) * 0.5)")
def lexicon(spark, d):
    mentions = head(spark, d, "text IS NOT NULL").select("doc_ord", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1))).alias("name"))
    return derive.lexicon(mentions, table(spark, d, "doc").count())


@query("lane_coverage", f"WITH m AS (SELECT segment_id, unnest(member_ids) AS block_id FROM segment), c AS (SELECT block_id FROM ({_HEAD}) WHERE trust = 2), s AS (SELECT segment_id, count(*) AS blocks, count(c.block_id) AS covered FROM m LEFT JOIN c USING (block_id) GROUP BY segment_id) SELECT segment_id, blocks, covered, covered / blocks < 0.6 AS billed FROM s")
def lane_coverage(spark, d):
    members = table(spark, d, "segment").select("segment_id", F.explode("member_ids").alias("block_id"))
    return derive.lane_coverage(members, head(spark, d, "trust = 2"), 0.6)


@query("invalidated_segments", f"WITH m AS (SELECT segment_id, doc_ord, unnest(member_ids) AS block_id FROM segment), o AS (SELECT DISTINCT doc_ord, addr, content_digest FROM block WHERE state = 1), x AS (SELECT m.segment_id, h.doc_ord, h.addr, h.content_digest FROM m JOIN ({_HEAD}) h USING (block_id)) SELECT DISTINCT segment_id AS work FROM x JOIN o ON o.doc_ord = x.doc_ord AND o.addr = x.addr WHERE o.content_digest <> x.content_digest")
def invalidated_segments(spark, d):
    """Segments with a member whose text at its address differs from a retired one's."""
    members = table(spark, d, "segment").select("segment_id", F.explode("member_ids").alias("block_id"))
    key = F.concat_ws("/", "doc_ord", "addr").alias("key")
    deps = members.join(head(spark, d).select("block_id", key, F.col("content_digest").alias("digest")), "block_id").select(F.col("segment_id").alias("work"), "key", "digest")
    old = table(spark, d, "block").where("state = 1").select(key, F.col("content_digest").alias("digest")).distinct()
    return derive.invalidated(deps, old)


@query("cohort_digest", "SELECT suite, sha256(string_agg(run_id, ',' ORDER BY run_id)) AS digest FROM eval_run GROUP BY suite")
def cohort_digest(spark, d):
    """A digest of each suite's set of runs."""
    return table(spark, d, "eval_run").groupBy("suite").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("run_id")), ","), 256).alias("digest"))


@query("priced_lines", "SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_quantity AS DECIMAL(18,0)) * 1250.5 + CAST(l_linenumber AS DECIMAL(18,0)) * 0.25, 0) AS BIGINT) AS micros FROM lineitem")
def priced_lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", derive.money([F.col("l_quantity"), F.col("l_linenumber")], ["1250.5", "0.25"]).alias("micros"))


#: Fixed values: (blocks below, characters, documents, characters a document, calls) of an answer, by the indexed blocks of the corpus.
TIERS = [(5000, 12000, 4, 3500, 1), (50000, 18000, 6, 4500, 2), (500000, 22000, 8, 5000, 3), (5000000, 24000, 8, 5500, 4), (9223372036854775807, 24000, 10, 5500, 5)]
_TIER_NAMES = ["max_chars", "max_docs", "chars_per_doc", "calls"]


@query("budget_tier", f"WITH n AS (SELECT count(*) AS blocks FROM ({_HEAD})) SELECT blocks, tier, {', '.join(_TIER_NAMES)} FROM n, (VALUES {', '.join(str((i, *t)) for i, t in enumerate(TIERS))}) t(tier, below, {', '.join(_TIER_NAMES)}) WHERE blocks < below ORDER BY below LIMIT 1")
def budget_tier(spark, d):
    """The room of an answer: the first tier whose bound the corpus's indexed blocks do not reach."""
    row = F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(t[0]).alias("below"), *[F.lit(v).alias(n) for n, v in zip(_TIER_NAMES, t[1:])]) for i, t in enumerate(TIERS)])
    n = head(spark, d).agg(F.count("*").alias("blocks"))
    return n.select("blocks", F.get(F.filter(row, lambda t: F.col("blocks") < t["below"]), 0).alias("t")).select("blocks", "t.tier", *[f"t.{n}" for n in _TIER_NAMES])



# Scalar functions


@query("text_functions", f"SELECT block_id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS words, CASE WHEN regexp_matches(trim(text), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'xsd:date' WHEN regexp_matches(trim(text), '^-?\\d+([.,]\\d+)?$') THEN 'xsd:decimal' ELSE 'string' END AS kind FROM ({_HEAD}) WHERE text IS NOT NULL")
def text_functions(spark, d):
    t = F.col("text")
    return head(spark, d, "text IS NOT NULL").select("block_id", text.token_cost(t).alias("tokens"), F.size(F.array_distinct(text.terms(t))).cast("bigint").alias("words"), text.data_type(t).alias("kind"))


@query("trigrams", "SELECT p_partkey, list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3)) AS grams FROM part")
def trigrams(spark, d):
    return table(spark, d, "part").select("p_partkey", text.ngrams(F.col("p_name"), 3).alias("grams"))


@query("label_entropy", "WITH c AS (SELECT c_custkey, unnest(string_split(c_mktsegment, '')) AS ch, length(c_mktsegment) AS l FROM customer), n AS (SELECT c_custkey, ch, l, count(*) AS k FROM c GROUP BY ALL) SELECT c_custkey, round(-sum(k / l * log2(k / l)), 9) AS entropy FROM n GROUP BY c_custkey")
def label_entropy(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(text.entropy(F.col("c_mktsegment")), 9).alias("entropy"))


@query("edit_distance", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance, round(jaro_winkler_similarity(a.n_name, b.n_name) * 100, 4) AS jw FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def edit_distance(spark, d):
    n = table(spark, d, "nation")
    a, b = (n.select(F.col("n_regionkey"), F.col("n_nationkey").alias(f"k{x}"), F.col("n_name").alias(x)) for x in "ab")
    pairs = a.join(b, "n_regionkey").where("ka < kb")
    return pairs.select("a", "b", F.levenshtein("a", "b").cast("bigint").alias("distance"), F.round(similarity.jaro_winkler_score(F.col("a"), F.col("b")), 4).alias("jw"))


@query("folded_keys")
def folded_keys(spark, d):
    """Blocking keys and quoting forms of all headings."""
    return labels(spark, d).select("id", text.normalize_key(F.col("label")).alias("key"), text.fold_text(F.col("label")).alias("folded"))


@query("assertion_diffs")
def assertion_diffs(spark, d):
    """Each quotation's least number of edits within any block of its page: the fuzzy check of 'present'."""
    a = table(spark, d, "eval_assertion").where("type = 'present' AND page IS NOT NULL").select("assertion_id", "doc", "page", "max_diffs", F.get_json_object("spec", "$.text").alias("quote")).dropDuplicates(["assertion_id"])
    doc = table(spark, d, "doc").select("doc_ord", F.col("uri").alias("doc"))
    page = head(spark, d, "text IS NOT NULL").select("doc_ord", "page", "text")
    near = a.join(doc, "doc").join(page, ["doc_ord", "page"])
    # Quotations that stand word for word in a block are settled first; only the others are compared with every block.
    exact = cut(near.where(F.contains("text", "quote")).select("assertion_id", "max_diffs").distinct())
    rest = near.join(exact.select("assertion_id"), "assertion_id", "left_anti").select("assertion_id", "max_diffs", similarity.least_diffs(F.col("quote"), F.col("text")).alias("diffs"))
    best = exact.withColumn("diffs", F.lit(0)).unionByName(rest.groupBy("assertion_id", "max_diffs").agg(F.min("diffs").alias("diffs")))
    return best.select("assertion_id", "diffs", (F.col("diffs") <= F.col("max_diffs")).alias("passed"))
