"""Names found in text: token n-grams meet the lexicon by an equi-join; leftmost, then longest matches stand."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


#: Words of a name that are looked up by an equi-join.
GRAM = 4


def find_names(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(block_id, name, at, words): names (one string column `name`) in the blocks' texts, of any number of words.

    The lexicon is never shipped whole: candidates are shuffled by their key, then a block's few matches are settled together.
    """
    key = lambda c: F.array_join(text.terms(c), " ")
    lexicon = names.select("name", key(F.col("name")).alias("whole"), text.terms(F.col("name")).alias("nw")).where(F.size("nw") > 0).dropDuplicates(["whole"])
    # A name is sought by its first GRAM words; what a longer one has beyond them is compared where those are found.
    lexicon = lexicon.select("name", "whole", F.size("nw").alias("size"), F.array_join(F.slice("nw", 1, GRAM), " ").alias("k"))
    words = blocks.where(F.col("text").isNotNull()).select("block_id", text.terms(F.col("text")).alias("w")).where(F.size("w") > 0)

    # The n-grams are put together inside one expression by index: a slice would read the whole text's words for each of them.
    def of(size: int):
        starts = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", *[F.get("w", i + j) for j in range(size)]).alias("k")))

    candidates = words.select("block_id", F.explode(F.concat(*[of(n) for n in range(1, GRAM + 1)])).alias("g")).select("block_id", "g.*")
    met = candidates.join(lexicon, "k")
    short = met.where(F.col("size") <= GRAM).select("block_id", "at", "size", "name")
    long = met.where(F.col("size") > GRAM).join(words, "block_id").where(F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ") == F.col("whole")).select("block_id", "at", "size", "name")
    hits = short.unionByName(long)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, end = None, 0
        for batch in batches:
            keep = []
            for b, at, minus in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if b != block:
                    block, end = b, 0
                keep.append(at >= end)
                if keep[-1]:
                    end = at - minus
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    ordered = hits.select("block_id", "at", (-F.col("size")).alias("minus"), "name").repartition("block_id").sortWithinPartitions("block_id", "at", "minus", "name")
    kind = dict(blocks.dtypes)["block_id"]
    return ordered.mapInArrow(settle, f"block_id {kind}, at int, minus int, name string").select("block_id", "name", "at", (-F.col("minus")).alias("words"))
