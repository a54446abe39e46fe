"""Queries of scalar functions, of exports and containers, and of query planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import retrieval
from ..session import table
from ..sources import containers
from ..streaming import events
from .catalog import query
from .reports import _HEAD, head
from .search import _BM25


@query("composed_texts", f"SELECT block_id, nfc_normalize(text) AS text FROM ({_HEAD}) WHERE text IS NOT NULL")
def composed_texts(spark, d):
    return head(spark, d, "text IS NOT NULL").select("block_id", text.nfc("text").alias("text"))


@query("index_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM ({_HEAD}) WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x20-\\x7e\\n]*')) GROUP BY term")
def index_terms(spark, d):
    """Terms of plain texts as the index folds them."""
    rows = head(spark, d).where(F.col("text").rlike(r"^[\x20-\x7e\n]*\z")).select(F.explode(text.terms(F.col("text"))).alias("t"))
    # Copies of a term are folded once.
    counted = rows.groupBy("t").agg(F.count("*").alias("k"))
    return counted.select(text.strip_accents("t").alias("term"), "k").groupBy("term").agg(F.sum("k").alias("n"))


#: Words that a question's terms leave out, unless nothing would remain.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with "
    "am been being can could did do does had has have how i its me my our should so than us we were what when where which who whom why would you your"
).split()


@query("content_terms", "WITH t AS (SELECT block_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM (" + _HEAD + ") WHERE kind = 'heading' AND text IS NOT NULL), c AS (SELECT block_id, w, list_filter(w, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")) AS k FROM t) SELECT block_id, array_to_string(list_sort(CASE WHEN len(k) > 0 THEN k ELSE w END), ' ') AS terms FROM c")
def content_terms(spark, d):
    """The terms of each heading without stopwords; with them where nothing else remains."""
    w = F.array_distinct(text.terms(F.col("text")))
    kept = F.array_except("w", F.array(*map(F.lit, STOPWORDS)))
    rows = head(spark, d, "kind = 'heading' AND text IS NOT NULL").select("block_id", w.alias("w"))
    return rows.select("block_id", F.array_join(F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(F.col("w"))), " ").alias("terms"))


CJK = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}]+"


@query("cjk_bigrams", f"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{CJK}')) AS run FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest(CASE WHEN length(run) < 2 THEN [run] ELSE list_transform(range(1, length(run)), lambda i: substr(run, i, 2)) END) AS gram FROM r) SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram")
def cjk_bigrams(spark, d):
    """Runs of Chinese, Japanese and Korean characters as overlapping pairs, by which they are searched; a lone character is its own."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"({CJK})"), 1))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", run.alias("run"))
    grams = F.when(F.char_length("run") < 2, F.array("run")).otherwise(text.ngrams(F.col("run"), 2))
    per_doc = rows.select("doc_id", F.explode(grams).alias("gram")).groupBy("gram", "doc_id").agg(F.count("*").alias("k"))
    return per_doc.groupBy("gram").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query("folded_views")
def folded_views(spark, d):
    """Texts folded for quoting, with the place each character came from."""
    return head(spark, d, "text IS NOT NULL").select("block_id", text.fold_views("text").alias("v")).select("block_id", "v.text", "v.places")


@query("plain_markdown", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^ {0,3}(#{1,6}|>|[-*+]|[0-9]+\.)[ \t]+', '', 'g'), '!?\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g'), '[*_`]{1,3}', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ') AS plain FROM documents WHERE text IS NOT NULL")
def plain_markdown(spark, d):
    """Texts without Markdown's marks, with single spaces, as assertions compare them."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.strip_markdown(F.col("text")).alias("plain"))


@query("vector_products", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS s FROM embeddings)
    SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS dot, round(list_cosine_similarity(a.v, b.v), 6) AS cos, CAST(list_sum(list_transform(list_zip(a.s, b.s), lambda p: CAST(p[1] <> p[2] AS INTEGER))) AS BIGINT) AS far FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vector_products(spark, d):
    """Each vector beside the next: dot product, cosine, and the Hamming distance of the signatures over every dimension."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    v, w = F.col("v"), F.col("w")
    rows = e.join(n, "vec_id")
    return rows.select("vec_id", F.round(similarity.dot(v, w), 6).alias("dot"), F.round(similarity.cosine(v, w), 6).alias("cos"), similarity.hamming(similarity.signature(v), similarity.signature(w)).cast("bigint").alias("far"))


@query("spend_since", "SELECT suite, count(*) AS runs, CAST(sum(spend_micros) AS BIGINT) AS micros FROM eval_run, (SELECT max(started_ns) AS last FROM eval_run) WHERE started_ns > last - 7 * 86400000000000 GROUP BY suite")
def spend_since(spark, d):
    """Spend of the last `7d`."""
    r = table(spark, d, "eval_run").select("suite", "spend_micros", "started_ns")
    last = r.agg(F.max("started_ns").alias("last"))  # one row
    recent = r.join(F.broadcast(last), F.col("started_ns") > F.col("last") - text.parse_duration("7d") * 1_000_000_000)
    return recent.groupBy("suite").agg(F.count("*").alias("runs"), F.sum("spend_micros").alias("micros"))


@query("otlp_spans", "SELECT md5(CAST(user_id AS VARCHAR)) AS trace_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS span_id, event_type AS name, CAST(epoch_us(ts) AS BIGINT) * 1000 AS start_ns, CAST(epoch_us(ts) AS BIGINT) * 1000 + CAST(round(value * 1000000) AS BIGINT) AS end_ns, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status FROM events")
def otlp_spans(spark, d):
    """Events in the shape of OTLP spans."""
    return events.otlp(table(spark, d, "events"))


@query("sql_functions", f"SELECT kind, count(*) AS n FROM ({_HEAD}) WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x20-\\x7e]*') AND trim(regexp_replace(lower(text), '[^a-z0-9_]+', '_', 'g'), '_') LIKE '%contract%' GROUP BY kind")
def sql_functions(spark, d):
    """SQL of a user over the registered functions."""
    from ..sdk import register_functions

    register_functions(spark)
    head(spark, d).where(F.col("text").rlike(r"^[\x20-\x7e]*\z")).createOrReplaceTempView("folio_head")
    return spark.sql("SELECT kind, count(*) AS n FROM folio_head WHERE normalize_key(text) LIKE '%contract%' GROUP BY kind")


@query("html_tables", "SELECT o_custkey AS table_id, '<table>' || string_agg('<tr><td>' || o_orderkey || '</td><td>' || replace(replace(replace(o_orderstatus, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>', '' ORDER BY o_orderkey) || '</table>' AS html FROM orders GROUP BY o_custkey")
def html_tables(spark, d):
    """Grids as HTML."""
    from ..operators import tables

    item = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    cells = item.select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("r"), F.inline(F.array(F.struct(F.lit(0).alias("c"), F.col("o_orderkey").cast("string").alias("text")), F.struct(F.lit(1).alias("c"), F.col("o_orderstatus").alias("text")))))
    return tables.html_table(cells)


@query("portable_export", f"SELECT doc_ord, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({_HEAD}) GROUP BY doc_ord")
def portable_export(spark, d):
    """Live blocks written as NDJSON in one folder a hash of documents, and read again."""
    path = events.work_dir(spark) + "/export"
    rows = head(spark, d).select("block_id", "doc_ord", "page", "ord", "kind", "text")
    rows.withColumn("part", F.pmod(F.xxhash64("doc_ord"), F.lit(16))).write.partitionBy("part").json(path)
    again = spark.read.schema(rows.schema).json(path)
    return again.groupBy("doc_ord").agg(F.count("*").alias("blocks"), F.sum(F.char_length("text")).alias("chars"))


@query("container_members", "SELECT doc_id, 'doc-' || doc_id || '.txt' AS member, CASE WHEN doc_id % 2 = 0 THEN 'zip' ELSE 'gz' END AS container, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL")
def container_members(spark, d):
    """Texts packed into zip and gzip files and expanded again."""
    return containers.roundtrip(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))


@query("loader_records", f"SELECT h.text AS page_content, d.uri AS source, h.cite FROM ({_HEAD}) h JOIN doc d USING (doc_ord) WHERE h.text <> ''")
def loader_records(spark, d):
    """Records of a retrieval framework's loader."""
    from ..sdk import corpus

    return corpus(spark, d).load().select("page_content", "metadata.source", "metadata.cite")


@query("query_plan")
def query_plan(spark, d):
    """The channels each question runs, in order, with their depth and the condition under which the rest is skipped."""
    from .search import QUESTIONS, parse_query

    rows = [(i, at, c, retrieval.DEPTHS[c], why, retrieval.SHORT[c]) for i, q in QUESTIONS for at, (c, why) in enumerate(retrieval.plan(parse_query(q)))]
    return spark.createDataFrame(rows, "query_id int, at int, channel string, depth int, status string, skips_rest_if string")


@query("federated_search", f"""WITH {_BM25}, sh AS (SELECT b.query_id, block_id, d.format AS shard, row_number() OVER (PARTITION BY query_id, d.format ORDER BY round(b.score, 9) DESC, block_id) AS rank FROM b JOIN h USING (block_id) JOIN doc d USING (doc_ord))
    SELECT query_id, block_id, shard, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, shard, block_id) AS place FROM sh WHERE rank <= 50) WHERE place <= 50""")
def federated_search(spark, d):
    """Lexical search of each format as a corpus of its own, merged by rank; scores of different corpora are not compared."""
    from .search import lexical

    docs = table(spark, d, "doc").select("doc_ord", F.col("format").alias("shard"))
    where = head(spark, d).select("block_id", "doc_ord").join(docs, "doc_ord").select("block_id", "shard")
    return retrieval.federate(lexical(spark, d).withColumn("score", F.round("score", 9)).join(where, "block_id"), 50)


@query("compaction", f"SELECT doc_ord, count(*) AS n FROM block GROUP BY doc_ord")
def compaction(spark, d):
    """The block table rewritten into files of an even size, sorted by document so that a document's pages lie in one."""
    from ..session import store

    rows = table(spark, d, "block").select("doc_ord", "block_id", "page", "ord")
    return store(rows.repartitionByRange("doc_ord").sortWithinPartitions("doc_ord", "page", "ord")).groupBy("doc_ord").agg(F.count("*").alias("n"))
