"""Ranked retrieval: lexical postings and BM25, channels, reciprocal rank fusion, ceilings, gates, packing and allocation.

Queries come as a frame (query_id, text), so that any number of them runs in one plan; each channel is a frame (query_id, block_id, score).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: The constant of rank fusion and the weights of the channels.
RANK_K = 60
WEIGHTS = {"identity": 2.0, "exact": 1.2, "lexical": 1.0, "semantic": 0.8, "structural": 0.4}
#: BM25.
K1, B = 1.2, 0.75
HEAD_WEIGHT, HEAD_DECAY = 6.0, 0.6


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(text.terms(F.col("text")))).alias("term"))


def postings(docs: DataFrame, id_col: str, text_col: str, only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, length): an inverted index; one shuffle on (id, term) with partial counts before it.

    With `only` (a frame with a column term) occurrences of other terms are dropped before anything is shuffled.
    """
    # The length is a column of its own before the explosion: after it, it would be computed for every word.
    split = docs.where(F.col(text_col).isNotNull()).select(id_col, text.terms(F.col(text_col)).alias("words"))
    exploded = split.withColumn("length", F.size("words").cast("bigint")).select(id_col, "length", F.explode("words").alias("term"))
    if only is not None:
        exploded = exploded.join(only.select("term").distinct(), "term", "left_semi")
    return exploded.groupBy(id_col, "term", "length").agg(F.count("*").alias("tf"))


def build_index(docs: DataFrame, id_col: str, text_col: str) -> tuple[str, str]:
    """Paths of the stored postings, in ranges of (term, id) so that a hot term is spread over files, and of their one row of statistics."""
    from ..session import store_path

    rows = postings(docs, id_col, text_col).repartitionByRange("term", id_col).sortWithinPartitions("term", id_col)
    path = store_path(rows)
    lengths = docs.sparkSession.read.parquet(path).select(id_col, "length").groupBy(id_col).agg(F.first("length").alias("length"))
    return path, store_path(lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean_length")))


def bm25(index: DataFrame, id_col: str, queries: DataFrame, size: DataFrame) -> DataFrame:
    """(query_id, id, score). Document frequencies come from the index rows the queries touch; a hot term is only a longer join run.
    size has one row (n_docs, mean_length)."""
    n_docs, mean_length = F.col("n_docs"), F.col("mean_length")
    wanted = query_terms(queries)
    touched = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = touched.groupBy("term").agg(F.count("*").alias("df"))
    # The one row of statistics is broadcast.
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    return touched.join(df, "term").join(wanted, "term").join(F.broadcast(size), F.lit(True)).groupBy("query_id", id_col).agg(F.sum(part).alias("score"))


def lift_headings(body: DataFrame, head: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Body scores plus the best decayed score of a heading ancestor: ancestors is (block_id, heading_id, distance)."""
    lifted = ancestors.join(head.select("query_id", F.col("block_id").alias("heading_id"), "score"), "heading_id")
    best = lifted.groupBy("query_id", "block_id").agg(F.max(F.col("score") * F.pow(F.lit(HEAD_DECAY), F.col("distance"))).alias("h"))
    both = body.join(best, ["query_id", "block_id"], "full")
    return both.select("query_id", "block_id", (F.coalesce("score", F.lit(0.0)) + HEAD_WEIGHT * F.coalesce("h", F.lit(0.0))).alias("score"))


def ranked(channel: DataFrame, depth: int) -> DataFrame:
    """The channel with ranks from 1, ties by block_id, cut at `depth` a query (the feature of a channel)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "block_id")
    return channel.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def fuse(channels: dict[str, DataFrame], depth: int = 50, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, block_id, score, channels): reciprocal rank fusion; one shuffle of the cut channels."""
    parts = [ranked(c, depth).select("query_id", "block_id", F.lit(name).alias("channel"), "rank", (F.lit(weights[name]) / (RANK_K + F.col("rank"))).alias("gain")) for name, c in channels.items()]
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("query_id", "block_id").agg(F.sum("gain").alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("channels"))


def ceiling(statuses: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, ceiling): the best score the channels that looked could give. statuses: (query_id, channel, status, reason)."""
    looked = F.col("status").isin("OK", "EMPTY") | ((F.col("status") == "OFF") & (F.col("reason") == "query_deadline"))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("channel"))
    return statuses.groupBy("query_id").agg(F.sum(F.when(looked, weight / (RANK_K + 1))).alias("ceiling"))


#: The depth of each channel, and after which of them the rest may be skipped.
DEPTHS = {"identity": 20, "exact": 50, "lexical": 50, "semantic": 50, "structural": 50}
SHORT = {"identity": "best grade >= 48", "exact": None, "lexical": None, "semantic": None, "structural": None}


def plan(parsed) -> list[tuple[str, str]]:
    """(channel, status) in the order of running; a channel without anything to ask is OFF."""
    words = bool(parsed.terms or parsed.phrases)
    numbered = any(t.isdigit() for t in parsed.terms)
    off = lambda on: "OK" if on else "OFF(nothing_to_ask)"
    return [("identity", off(words)), ("exact", off(numbered)), ("lexical", off(words)), ("semantic", off(words)), ("structural", off(words))]


def short_circuit(graded: DataFrame, least: float = 48.0) -> DataFrame:
    """(query_id): queries that an identity of at least this grade answers, for which later channels are skipped."""
    return graded.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") >= least).select("query_id")


def federate(hits: DataFrame, depth: int) -> DataFrame:
    """(query_id, block_id, shard, rank, place): ranked hits (query_id, block_id, score, shard) of several corpora merged by rank, ties by shard."""
    own = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "block_id")
    cut = hits.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= depth)
    order = Window.partitionBy("query_id").orderBy("rank", "shard", "block_id")
    return cut.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth).select("query_id", "block_id", "shard", "rank", "place")


BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def _blocks(df: DataFrame, id_col: str, vector_col: str, rows: int, prefix: str) -> DataFrame:
    """Unit vectors packed into matrices of at most `rows` rows: (ids ARRAY<BIGINT>, m BINARY, dim). Null, zero and infinite vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int, ids: list, vectors: list) -> pa.RecordBatch:
            x = np.asarray(vectors, dtype=np.float64)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            x = x[good] / norm[good, None]
            return pa.RecordBatch.from_arrays([pa.array([[i for i, g in zip(ids, good) if g]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([dim], pa.int32())], names=[f"{prefix}_ids", f"{prefix}_m", f"{prefix}_dim"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield out(len(v), *held.pop(len(v)))
        for dim, (ids, vectors) in held.items():
            yield out(dim, ids, vectors)

    return df.select(F.col(id_col).cast("bigint"), vector_col).mapInArrow(run, f"{prefix}_ids array<bigint>, {prefix}_m binary, {prefix}_dim int")


def semantic(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, block_id, score): the `top` nearest rows by cosine of each query of a stated set, itself left out.

    vectors (block_id, v), queries (query_id, q). Both sides are packed into matrices and met block by block; a meeting hands on its best
    `top` for each query only, ties by block_id.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, qids = np.array(r["v_ids"], dtype=np.int64), np.array(r["q_ids"], dtype=np.int64)
                if not len(ids) or not len(qids) or r["v_dim"] != r["q_dim"]:
                    continue
                s = np.frombuffer(r["q_m"]).reshape(len(qids), -1) @ np.frombuffer(r["v_m"]).reshape(len(ids), -1).T
                s = np.round(s, 9)
                s[qids[:, None] == ids[None, :]] = -2
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :top]
                best = np.take_along_axis(s, order, 1)
                q, b, c = np.repeat(qids, order.shape[1]), ids[order].ravel(), best.ravel()
                keep = c > -2
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(b[keep]), pa.array(c[keep])], names=["query_id", "block_id", "score"])

    met = _blocks(vectors, "block_id", "v", BLOCK_ROWS, "v").crossJoin(_blocks(queries, "query_id", "q", QUERY_ROWS, "q"))
    return ranked(met.mapInArrow(meet, "query_id bigint, block_id bigint, score double"), top).select("query_id", "block_id", "score", "rank")


#: The gates in their order.
GATES = [
    "timed_out", "channel_unavailable", "store_changed_mid_query", "coverage_incomplete", "pending_work_in_scope", "source_edited_unindexed", "freshness_unknown", "inputs_unreadable",
    "parse_gap_in_scope", "restricted_withheld", "filter_starved", "truncated_by_packing", "space_mismatch", "shard_unreachable", "similarity_only",
]


def verdict(facts: DataFrame, hits: str = "hits") -> DataFrame:
    """Adds causes (each failing gate, in order) and state: ok with hits, absent without hits and causes, degraded otherwise. Facts have a boolean column per gate."""
    have = set(facts.columns)
    causes = F.array_compact(F.array(*[F.when(F.col(g), F.lit(g)) for g in GATES if g in have]))
    with_causes = facts.withColumn("causes", causes)
    return with_causes.withColumn("state", F.when(F.size("causes") > 0, "degraded").when(F.col(hits) > 0, "ok").otherwise("absent"))


def pack(hits: DataFrame, max_chars: int, chars: Column) -> DataFrame:
    """The prefix of each query's hits (by rank) whose characters fit: it stops at the first that does not."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("upto", F.sum(chars).over(order)).where(F.col("upto") <= max_chars)
