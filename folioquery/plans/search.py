"""Queries of the retrieval operators: a fixed set of questions against every live block."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval
from ..operators.filters import Filters
from ..session import path_exists, table, table_state
from .catalog import query
from .reports import _HEAD, head

QUESTIONS = [(1, "retention schedule"), (2, "maintenance contract invalidates the ledger"), (3, "Prüfprotokoll Bestandsverzeichnis"), (4, "première copie"), (5, "quantum chromodynamics"), (6, "Delivery conditions"), (7, "open questions")]
_QUESTIONS_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS) + ") q(query_id, text)"

_FIELDS = {"kind": "kinds", "layer": "layers", "lang": "lang", "sec": "section_prefix"}


@dataclass
class ParsedQuery:
    """A question taken apart: fields become filters, quoted runs phrases, the rest terms."""

    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    filters: Filters = field(default_factory=Filters)


def parse_query(question: str) -> ParsedQuery:
    """Parse `kind: layer: lang: sec: page: doc: trust: quote:` fields, "phrases" and terms; unknown fields stay text."""
    import re

    out, found = ParsedQuery(), {}
    rest = question
    for phrase in re.findall(r'"([^"]+)"', rest):
        out.phrases.append(phrase)
    rest = re.sub(r'"[^"]*"', " ", rest)
    for word in rest.split():
        name, _, value = word.partition(":")
        if value and name in _FIELDS:
            found[_FIELDS[name]] = tuple(value.split(",")) if name in ("kind", "layer") else value
        elif value and name in ("trust", "quote") and value.isdigit():
            found["min_" + name] = int(value)
        elif value and name == "page" and re.fullmatch(r"\d+(-\d+)?", value):
            a, _, b = value.partition("-")
            found["pages"] = (int(a), int(b or a))
        elif value and name == "doc" and re.fullmatch(r"d?\d+", value):
            found["doc_ords"] = (int(value.lstrip("d")),)
        else:
            out.terms += re.findall(r"[^\W_]+", word.lower())
    out.terms, out.filters = out.terms, Filters(**found)
    return out


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, text string")


def index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of the live blocks, written once into the shared folder for a state of the tables and kept for the application.

    Postings (term, block_id, tf, length) lie in the order of terms, so that the scan of a question skips the files and row groups of other terms.
    """
    state = (d, *(table_state(spark, f"{d}/{t}.parquet") for t in ("block", "doc")))
    kept = spark.sparkContext.__dict__.setdefault("_folioquery_index", {})
    if state not in kept or not all(path_exists(spark, p) for p in kept[state]):
        kept[state] = retrieval.build_index(head(spark, d, "text IS NOT NULL").select("block_id", "text"), "block_id", "text")
    return tuple(spark.read.parquet(p) for p in kept[state])


def lexical(spark: SparkSession, d: str) -> DataFrame:
    postings, size = index(spark, d)
    terms = sorted({w for _, q in QUESTIONS for w in parse_query(q).terms})
    return retrieval.bm25(postings.where(F.col("term").isin(terms)), "block_id", questions(spark), size)


@query("index_size", f"WITH t AS (SELECT block_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({_HEAD}) WHERE text IS NOT NULL) SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS words FROM (SELECT block_id, term, count(*) AS tf FROM (SELECT block_id, unnest(w) AS term FROM t) GROUP BY ALL)")
def index_size(spark, d):
    """The stored index, built here if it is not yet."""
    return index(spark, d)[0].agg(F.count("*").alias("postings"), F.sum("tf").alias("words"))


_BM25 = f"""h AS ({_HEAD}), t AS (SELECT block_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM h WHERE text IS NOT NULL),
    p AS (SELECT block_id, len(w) AS l, term, count(*) AS tf FROM (SELECT block_id, w, unnest(w) AS term FROM t) GROUP BY ALL),
    s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM t WHERE len(w) > 0),
    qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(q.text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {_QUESTIONS_SQL}),
    df AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM qt) GROUP BY term),
    b AS (SELECT query_id, block_id, sum(greatest(ln((s.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / s.m))) AS score FROM p JOIN df USING (term) JOIN qt USING (term), s GROUP BY ALL)"""


@query("lexical_bm25", f"WITH {_BM25} SELECT query_id, block_id, round(score, 6) AS score FROM b")
def lexical_bm25(spark, d):
    return lexical(spark, d).select("query_id", "block_id", F.round("score", 6).alias("score"))


def identity(spark: SparkSession, d: str) -> DataFrame:
    """Headings graded against each question."""
    titles = head(spark, d, "kind IN ('heading', 'title') AND text IS NOT NULL").select("block_id", "text")
    graded = titles.join(F.broadcast(questions(spark).withColumnRenamed("text", "wanted")), text.title_grade(F.col("text"), F.col("wanted")) > 0)
    return graded.select("query_id", "block_id", text.title_grade(F.col("text"), F.col("wanted")).cast("double").alias("score"))


_KEY = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '_', 'g'), '_')"
_IDENTITY = f"""i AS (SELECT query_id, block_id, CAST(CASE WHEN h.text = '' THEN 0 WHEN lower(h.text) = lower(q.text) THEN 45 WHEN {_KEY.format('h.text')} = {_KEY.format('q.text')} THEN 40 WHEN starts_with(lower(h.text), lower(q.text)) OR starts_with(lower(q.text), lower(h.text)) THEN 30 ELSE 0 END AS DOUBLE) AS score
    FROM h, {_QUESTIONS_SQL} WHERE kind IN ('heading', 'title') AND h.text IS NOT NULL)"""


@query("identity_grades", f"WITH h AS ({_HEAD}), {_IDENTITY} SELECT query_id, block_id, score FROM i WHERE score > 0")
def identity_grades(spark, d):
    return identity(spark, d)


@query(
    "fused_search",
    f"""WITH {_BM25}, {_IDENTITY},
        l AS (SELECT query_id, block_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, block_id) AS r, 1.0 AS w FROM b), n AS (SELECT query_id, block_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) AS r, 2.0 AS w FROM i WHERE score > 0)
        SELECT query_id, block_id, round(sum(w / (60 + r)), 9) AS score FROM (SELECT * FROM l WHERE r <= 50 UNION ALL SELECT * FROM n WHERE r <= 50) GROUP BY ALL""",
)
def fused_search(spark, d):
    """Headings and text fused by reciprocal rank."""
    body = lexical(spark, d).withColumn("score", F.round("score", 9))
    return retrieval.fuse({"lexical": body, "identity": identity(spark, d)}).select("query_id", "block_id", F.round("score", 9).alias("score"))


@query("search_verdict")
def search_verdict(spark, d):
    """Per question: hits, best score against the ceiling, and why an empty answer is empty."""
    fused = fused_search(spark, d).groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))
    q = questions(spark)
    statuses = q.select("query_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("reason")) for c in ("lexical", "identity")])).alias("s")).select("query_id", "s.*")
    pending = table(spark, d, "vpending").limit(1).select(F.lit(True).alias("pending_work_in_scope"))
    partial = table(spark, d, "doc").where("status <> 'ok'").limit(1).select(F.lit(True).alias("coverage_incomplete"))
    facts = q.select("query_id").join(fused, "query_id", "left").na.fill(0, ["hits"]).join(retrieval.ceiling(statuses), "query_id")
    facts = facts.join(pending, F.lit(True), "left").join(partial, F.lit(True), "left").na.fill(False)
    return retrieval.verdict(facts).select("query_id", "hits", F.try_divide("best", "ceiling").alias("confidence"), "causes", "state")


@query(
    "semantic_neighbours",
    """WITH v AS (SELECT vec_id AS block_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT q.block_id AS query_id, v.block_id, list_cosine_similarity(q.v, v.v) AS score FROM v q, v WHERE q.block_id % 20 = 0 AND q.block_id <> v.block_id)
       SELECT query_id, block_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, block_id) AS r FROM c) WHERE r <= 10""",
)
def semantic_neighbours(spark, d):
    """Exact search: every twentieth vector against all."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("block_id"), F.col("embedding").alias("v"))
    q = v.where("block_id % 20 = 0").select(F.col("block_id").alias("query_id"), F.col("v").alias("q"))
    return retrieval.semantic(v, q, 10).select("query_id", "block_id")


@query(
    "signature_search",
    """WITH s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS b FROM embeddings),
       c AS (SELECT q.id AS query_id, s.id AS block_id, list_sum(list_transform(list_zip(q.b, s.b), lambda p: CAST(p[1] <> p[2] AS INTEGER))) AS far FROM s q, s WHERE q.id % 20 = 0 AND q.id <> s.id)
       SELECT query_id, block_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, block_id) AS r FROM c) WHERE r <= 10""",
)
def signature_search(spark, d):
    """The nearest by Hamming distance of sign signatures: every twentieth vector against all, as cosines of vectors of signs."""
    signs = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("block_id"), signs.alias("v"))
    q = s.where("block_id % 20 = 0").select(F.col("block_id").alias("query_id"), F.col("v").alias("q"))
    return retrieval.semantic(s, q, 10).select("query_id", "block_id")


@query("packed_hits", f"WITH {_BM25}, r AS (SELECT query_id, block_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, block_id) AS rank FROM b) SELECT query_id, block_id FROM (SELECT r.query_id, r.block_id, sum(length(h.text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS c FROM r JOIN h USING (block_id) WHERE rank <= 50) WHERE c <= 4000")
def packed_hits(spark, d):
    hits = retrieval.ranked(lexical(spark, d).withColumn("score", F.round("score", 9)), 50).join(head(spark, d).select("block_id", F.char_length("text").alias("chars")), "block_id")
    return retrieval.pack(hits, 4000, F.col("chars")).select("query_id", "block_id")
