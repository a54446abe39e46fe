"""Derivation: heading paths, segmentation, references and anchors, defined terms, lexicon, lane coverage, invalidation, answer allocation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Fixed values of the segmenter, in tokens and blocks.
TARGET, MOST, MOST_BLOCKS = 1200, 2048, 512


def heading_path(blocks: DataFrame) -> DataFrame:
    """Adds heading_id: the nearest heading at or before each block of its document in reading order."""
    order = Window.partitionBy("doc_ord").orderBy("page", "ord", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading_id", F.last(F.when(F.col("kind").isin("heading", "title", "section"), F.col("block_id")), ignorenulls=True).over(order))


def segments(blocks: DataFrame) -> DataFrame:
    """(doc_ord, layer, heading_id, seq, block_id, tokens): greedy packing of a section's blocks in reading order.

    A segment closes when the next block would pass MOST tokens or MOST_BLOCKS, or on reaching TARGET; a block over MOST stands alone. The
    stream of a task is sorted by (document, layer, order) and is read block by block: only counters are held.
    """
    rows = heading_path(blocks).select("doc_ord", "layer", "heading_id", "page", "ord", "block_id", text.token_cost(F.coalesce("text", F.lit(""))).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, held, n = None, 0, 0, 0
        for batch in batches:
            seqs = []
            for doc, layer, heading, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if (doc, layer, heading) != key:
                    seq = seq + 1 if key and key[:2] == (doc, layer) else 0
                    key, held, n = (doc, layer, heading), 0, 0
                elif n and (held >= TARGET or held + tokens > MOST or n >= MOST_BLOCKS):
                    seq, held, n = seq + 1, 0, 0
                held, n = held + tokens, n + 1
                seqs.append(seq)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(seqs, pa.int32()), batch.column(3), batch.column(4)], names=["doc_ord", "layer", "heading_id", "seq", "block_id", "tokens"])

    ordered = rows.repartition("doc_ord", "layer").sortWithinPartitions("doc_ord", "layer", "page", "ord", "block_id").select("doc_ord", "layer", "heading_id", "block_id", "tokens")
    return ordered.mapInArrow(run, "doc_ord bigint, layer string, heading_id bigint, seq int, block_id bigint, tokens bigint")


#: Shapes of references, by kind of anchor.
REFERENCES = {
    "section": r"(?:Sec\.|Section|§)\s*(\d+(?:\.\d+)*)",
    "figure": r"(?:Fig\.|Figure)\s*(\d+[a-z]?)",
    "table": r"Table\s+(\d+(?:[-.]\d+)?)",
    "article": r"Art\.\s*(\d+)",
    "page": r"\bp\.\s*(\d+)",
    "volume": r"\bvol\.\s*(\d+)",
}
#: Sites of a kind in a block beyond which a notice is given (reference_notices); none is left out.
SITES_PER_BLOCK = 32


def references(blocks: DataFrame) -> DataFrame:
    """(block_id, doc_ord, akind, name): everything each block refers to."""

    def sites(kind: str, pattern: str) -> Column:
        names = F.regexp_extract_all("text", F.lit(pattern), 1)
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("akind"), x.alias("name")))

    found = [sites(k, p) for k, p in REFERENCES.items()]
    return blocks.where(F.col("text").isNotNull()).select("block_id", "doc_ord", F.explode(F.array_distinct(F.concat(*found))).alias("r")).select("block_id", "doc_ord", "r.*")


def anchors(blocks: DataFrame) -> DataFrame:
    """(block_id, doc_ord, akind, name): numbered headings define a section of their number."""
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)\.?\s", 1)
    return blocks.where("kind IN ('heading', 'title') AND text IS NOT NULL").select("block_id", "doc_ord", F.lit("section").alias("akind"), number.alias("name")).where("name <> ''")


def resolve_references(refs: DataFrame, defined: DataFrame, corpus_scope: bool = False) -> DataFrame:
    """(block_id, akind, name, target): references joined to anchors of their name, in their document or in the whole corpus."""
    a = defined.select(F.col("block_id").alias("target"), F.col("doc_ord").alias("anchor_doc"), "akind", "name")
    joined = refs.join(a, ["akind", "name"])
    return (joined if corpus_scope else joined.where("anchor_doc = doc_ord")).select("block_id", "akind", "name", "target")


def unresolved_references(refs: DataFrame, defined: DataFrame) -> DataFrame:
    """References without an anchor in their document."""
    return refs.join(defined.select("doc_ord", "akind", "name"), ["doc_ord", "akind", "name"], "left_anti")


#: How a text defines a term: quoted, then said to mean something; in brackets; "hereinafter".
_TERM = r"(?:\"([^\"\n]{1,80})\"|“([^”\n]{1,80})”|‘([^’\n]{1,80})’|«\s?([^»\n]{1,80}?)\s?»)"
_MEANS = r"\s*(?:shall\s+mean|means|refers\s+to|is\s+defined\s+as|(?:shall\s+)?ha(?:s|ve)\s+the\s+meanings?|bezeichnet|bedeutet|désigne|signifie|significa|designa)\b"
DEFINITIONS = {
    "copular": _TERM + r"(?:\s+[^\s\"“”‘’.;:]+){0,3}?" + _MEANS,
    "parenthetical": r"\(\s*(?:[Tt]he\s+)?" + _TERM + r"\s*\)",
    "hereinafter": r"\(\s*(?:[Hh]ereinafter|[Nn]achfolgend|[Cc]i-après|[Ee]n adelante)(?:\s+(?:referred\s+to\s+as|called))?\s*,?\s*(?:[Tt]he\s+)?" + _TERM + r"\s*\)",
    "named": r"(?:code word|Kennwort|lema|mot(?: de passe)?|term|keyword|palabra)\s+" + _TERM,
}
#: Fixed value: the least length of a term's key.
LEAST_KEY = 3


def defined_terms(blocks: DataFrame) -> DataFrame:
    """(block_id, form, term): every term a text defines, once a block and form; terms with a key of under three characters are none."""

    def terms(form: str, pattern: str) -> Column:
        groups = [F.regexp_extract_all("text", F.lit(pattern), i) for i in range(1, 5)]
        return F.transform(F.array_distinct(F.filter(F.concat(*groups), lambda x: F.char_length(text.title_key(x)) >= LEAST_KEY)), lambda x: F.struct(F.lit(form).alias("form"), x.alias("term")))

    found = F.concat(*[terms(f, p) for f, p in DEFINITIONS.items()])
    return blocks.where(F.col("text").isNotNull()).select("block_id", F.explode(found).alias("d")).select("block_id", "d.form", "d.term")


def lexicon(mentions: DataFrame, documents: int, most_share: float = 0.5) -> DataFrame:
    """(name, docs): names of at least four characters, without those in two or more documents and over half of all."""
    seen = mentions.where(F.char_length("name") >= 4).groupBy("name").agg(F.count_distinct("doc_ord").alias("docs"))
    return seen.where(~((F.col("docs") >= 2) & (F.col("docs") > F.lit(documents * most_share))))


def lane_coverage(members: DataFrame, covered: DataFrame, floor: float) -> DataFrame:
    """(segment_id, blocks, covered, billed): the share of a segment's blocks that cheaper lanes cover; below the floor it is billed."""
    hits = members.join(covered.select("block_id").distinct().withColumn("hit", F.lit(1)), "block_id", "left")
    share = hits.groupBy("segment_id").agg(F.count("*").alias("blocks"), F.count("hit").alias("covered"))
    return share.withColumn("billed", F.col("covered") / F.col("blocks") < floor)


def invalidated(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """(work): work whose recorded digest of a dependency is not the present one. deps (work, key, digest), changed (key, digest)."""
    now = changed.select("key", F.col("digest").alias("now"))
    return deps.join(now, "key").where(F.col("now").isNull() | (F.col("digest") != F.col("now"))).select("work").distinct()


def money(units: list[Column], rates: list[str]) -> Column:
    """Units times decimal rates, summed exactly and rounded once, half to even, to whole micros."""
    total = sum((u.cast("decimal(18,0)") * F.lit(r).cast("decimal(18,9)") for u, r in zip(units[1:], rates[1:])), units[0].cast("decimal(18,0)") * F.lit(rates[0]).cast("decimal(18,9)"))
    return F.bround(total, 0).cast("bigint")


def allocate(candidates: list[dict], envelope: int, per_doc: int = 180, per_block: int = 95, buy_share: float = 0.15, pool_share: float = 0.6, least: int = 600) -> list[dict]:
    """Characters for each document of one answer. candidates: doc, weight, demand, blocks; in order of first appearance.

    Room is reserved per document and block and a buy pool held back; the rest goes by weight, capped by demand and by a share of the
    pool, what is left over carries on. The last document that got less than it asked for and less than `least` drops out, and again.
    """
    kept = list(candidates)
    while kept:
        reserve = sum(per_doc + per_block * c["blocks"] for c in kept)
        pool = max(0, envelope - reserve) * (1 - buy_share)
        left, weight, out = pool, sum(c["weight"] for c in kept), []
        for c in kept:
            share = left * c["weight"] / weight if weight else 0.0
            given = int(min(share, c["demand"], pool * pool_share))
            out.append({"doc": c["doc"], "chars": given})
            left, weight = left - given, weight - c["weight"]
        short = [i for i, (c, o) in enumerate(zip(kept, out)) if o["chars"] < c["demand"] and o["chars"] < least]
        if not short or len(kept) == 1:
            return out
        kept.pop(short[-1])
    return []
