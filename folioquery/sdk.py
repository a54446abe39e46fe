"""The library's face: a corpus over a data directory, its queries, its documents, and user functions for SQL.

    from folioquery.sdk import corpus
    c = corpus(spark, "/data")
    c.card().show(); c.query("fused_search").show(); c.doc(7).blocks(pages=(0, 3)).show()
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table


@dataclass(frozen=True)
class Config:
    """Settings by name; `semantic` ones change results and enter the digest, `operational` ones do not. Later sources win: defaults, file, environment, call."""

    semantic: dict = field(default_factory=dict)
    operational: dict = field(default_factory=dict)

    #: Names and defaults.
    SEMANTIC = {"channels.depth": 50, "fusion.k": 60, "packing.max_chars": 4000, "resolve.merge_at": 92.0}
    OPERATIONAL = {"shuffle.partitions": 200, "tokenizer.dir": "/opt/tokenizers"}

    @classmethod
    def resolve(cls, *sources: dict) -> Config:
        """Merged settings; an unknown name is an error, a value takes the type of its default."""
        known, values = cls.SEMANTIC | cls.OPERATIONAL, {}
        for source in sources:
            for name, value in source.items():
                if name not in known:
                    raise KeyError(f"unknown setting {name}")
                values[name] = type(known[name])(value)
        merged = known | values
        return cls({n: merged[n] for n in cls.SEMANTIC}, {n: merged[n] for n in cls.OPERATIONAL})

    def digest(self) -> str:
        import hashlib
        import json

        return hashlib.sha256(json.dumps(self.semantic, sort_keys=True).encode()).hexdigest()


class Doc:
    """Reads of one document in its head generation; nothing is read before a result is."""

    def __init__(self, owner: Corpus, doc_ord: int) -> None:
        self.owner, self.doc_ord = owner, doc_ord

    def blocks(self, pages: tuple[int, int] | None = None, kinds: Sequence[str] = (), layers: Sequence[str] = ()) -> DataFrame:
        rows = self.owner.blocks().where(F.col("doc_ord") == self.doc_ord)
        for column, values in (("kind", kinds), ("layer", layers)):
            rows = rows.where(F.col(column).isin(list(values))) if values else rows
        return rows.where(F.col("page").between(*pages)) if pages else rows

    def subtree(self, block_id: int) -> DataFrame:
        from .operators import graph

        rows = self.blocks()
        edges = rows.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("parent"), F.col("block_id").alias("child"))
        roots = rows.where(F.col("block_id") == block_id).select(F.col("block_id").alias("root"))
        return rows.join(graph.descend(edges, roots).select(F.col("node").alias("block_id"), "depth"), "block_id")

    def quote(self, block_id: int, words: str) -> DataFrame:
        """(block_id, exact): whether the words stand in a block that may be quoted verbatim."""
        rows = self.blocks().where(F.col("block_id") == block_id)
        return rows.select("block_id", (F.contains("text", F.lit(words)) & (F.col("quote") >= 3)).alias("exact"))


class Corpus:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None) -> None:
        self.spark, self.path, self.config = spark, path, config or Config.resolve()

    def blocks(self) -> DataFrame:
        from .plans.reports import head

        return head(self.spark, self.path)

    def query(self, name: str) -> DataFrame:
        """A registered query over this corpus."""
        from .plans import catalog

        return catalog.queries()[name](self.spark, self.path)

    def card(self) -> DataFrame:
        return self.query("corpus_counts")

    def coverage(self) -> DataFrame:
        return self.query("vector_coverage")

    def doctor(self) -> DataFrame:
        return self.query("graph_doctor")

    def doc(self, doc_ord: int) -> Doc:
        return Doc(self, doc_ord)

    def load(self) -> DataFrame:
        """(page_content, metadata): live blocks with text as records for a retrieval framework's loader."""
        rows = self.blocks().where("text <> ''").join(table(self.spark, self.path, "doc").select("doc_ord", "uri"), "doc_ord")
        return rows.select(F.col("text").alias("page_content"), F.struct(F.col("uri").alias("source"), "page", "cite", "kind").alias("metadata"))

    def lazy_load(self) -> Iterator[dict]:
        """The records of load() one by one; partitions come to the driver one at a time."""
        for row in self.load().toLocalIterator():
            yield row.asDict(recursive=True)


def corpus(spark: SparkSession, path: str, config: Config | None = None) -> Corpus:
    return Corpus(spark, path, config)


def register_functions(spark: SparkSession) -> None:
    """User functions for SQL, as Arrow batches: normalize_key, jaro_winkler, fold_text."""
    from .functions import similarity, text

    for name, f in (("normalize_key", text.fold_keys), ("jaro_winkler", similarity.jaro_winkler_score), ("fold_text", text.strip_accents)):
        spark.udf.register(name, f)
