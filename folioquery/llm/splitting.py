"""Problem 4: splitting oversized items at natural boundaries, by content-defined chunking.

A rolling hash over the last WINDOW characters marks landmarks. A piece may end from its least to its greatest size; it ends at the
natural boundary nearest to the first landmark there (a paragraph end near it before a sentence end, that before any other
gap), or at the last boundary where there is no landmark. As landmarks and boundaries depend on the text around them only, an edit alters
the pieces next to it and no others. Only a stretch that is longer than a piece and has no boundary at all is cut inside ('forced').
A piece repeats up to `overlap` characters of the one before it, from a boundary on.

Defined results: null and empty texts have no piece; a text of at most max_chars characters is one piece; characters are Unicode
code points; keys delivered twice count once; a key without a segment or a model has no piece.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width

WINDOW = 24
#: Fixed value: the marks that, beside white space, end a stretch.
STOPS = ".!?;:,。！？；：、।؟"
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[.!?।؟]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*|\n")
_GAP = re.compile(rf"[\s{re.escape(STOPS)}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def landmarks(text: str, divisor: int) -> np.ndarray:
    """Positions whose WINDOW characters before them hash to 0 modulo divisor."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    mixed = codes * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for j in range(min(WINDOW, len(codes))):
        rolled[j:] += mixed[: len(codes) - j] << np.uint64(j)
    rolled ^= rolled >> np.uint64(31)
    at = np.flatnonzero((rolled * _MIX >> np.uint64(33)) % np.uint64(divisor) == 0) + 1
    return at[at >= WINDOW]


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Positions of paragraph ends, sentence ends and of the edges of all gaps, each in order."""
    gaps: list[int] = []
    for m in _GAP.finditer(text):
        a, b = m.span()
        gaps.append(a) if not gaps or gaps[-1] != a else None
        gaps.extend(range(a + 1, b + 1))
    return [m.end() for m in _PARAGRAPH.finditer(text)], [m.end() for m in _SENTENCE.finditer(text)], gaps


def _nearest(points: list[int], to: int, low: int, high: int) -> int | None:
    i = bisect_left(points, to)
    best = [p for p in points[max(0, i - 1) : i + 1] if low <= p <= high]
    return min(best, key=lambda p: (abs(p - to), p)) if best else None


def pieces(text: str | None, max_chars: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, core, end, cut) of each piece text[start:end]; text[core:end] in order give the text; cut says why it ends.

    cut is 'paragraph', 'sentence', 'gap' or 'forced', and 'end' for the last piece. max_chars below 1 is refused.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")
    if not text:
        return []
    n = len(text)
    if n <= max_chars:
        return [(0, 0, n, "end")]
    overlap = max(0, min(overlap, max_chars // 2))
    least = max(1, (max_chars - overlap) // 3)
    reach = max(1, (max_chars - overlap) // 6)
    marks = landmarks(text, max(1, (max_chars - overlap) // 3)).tolist()
    paragraphs, sentences, gaps = boundaries(text)
    out, core = [], 0
    while True:
        start = core
        if core and overlap:  # the first boundary from which the overlap is not too long
            i = bisect_left(gaps, core - overlap)
            start = gaps[i] if i < len(gaps) and gaps[i] < core else core
            while start < core and text[start].isspace():
                start += 1
        if n - start <= max_chars:
            out.append((start, core, n, "end"))
            return out
        top = start + max_chars
        i = bisect_right(gaps, top)
        if start < core and (not i or gaps[i - 1] <= core):
            start, top = core, core + max_chars
            if n - start <= max_chars:
                out.append((start, core, n, "end"))
                return out
            i = bisect_right(gaps, top)
        if not i or gaps[i - 1] <= core:
            end, cut = top, "forced"
            while end > core + 1 and unicodedata.combining(text[end]):
                end -= 1
        else:
            low = min(core + least, gaps[i - 1])
            j = bisect_left(marks, low)
            mark = marks[j] if j < len(marks) and marks[j] <= top else None
            to = top if mark is None else mark
            for points, cut, near in ((paragraphs, "paragraph", reach), (sentences, "sentence", reach), (gaps, "gap", max_chars)):
                end = _nearest(points, to, max(low, to - near), min(top, to + near))
                if end is not None:
                    break
        out.append((start, core, end, cut))
        core = end


def segment_texts(segment: DataFrame, block: DataFrame) -> DataFrame:
    """(content_digest, text): the texts of a segment's members in order, one line feed between; blocks delivered twice count once."""
    members = segment.select("content_digest", F.posexplode("member_ids").alias("at", "block_id"))
    texts = block.select("block_id", F.coalesce("text", F.lit("")).alias("text"))
    # The width is stated: cutting texts is work of the processor, which the few bytes shuffled do not show to adaptive coalescing.
    spread = members.join(texts, "block_id").repartition(shuffle_width(block.sparkSession), "content_digest")
    parts = spread.groupBy("content_digest").agg(F.array_sort(F.collect_set(F.struct("at", "text"))).alias("parts"))
    # Should two deliveries of a member differ, the lesser text stands.
    first = F.filter("parts", lambda x, i: (i == 0) | (F.get("parts", i - 1)["at"] != x["at"]))
    return parts.select("content_digest", F.array_join(F.transform(first, lambda x: x["text"]), "\n").alias("text"))


_PIECE = "array<struct<start:int,core:int,end:int,cut:string,text:string>>"


def split_pending(pending: DataFrame, segment: DataFrame, block: DataFrame, space: DataFrame, with_text: bool = True) -> DataFrame:
    """(model_key, segment_digest, n_chars, pieces): each pending key once, cut for its model's input size.

    A text is assembled once for all models that wait for it; what pending claims of its size is not read.
    """
    wanted = pending.select("model_key", "segment_digest").distinct().join(space.select("model_key", "max_chars", "overlap_chars"), "model_key")
    per_segment = wanted.groupBy("segment_digest").agg(F.collect_set(F.struct("model_key", "max_chars", "overlap_chars")).alias("models"))
    due = segment.join(per_segment.select(F.col("segment_digest").alias("content_digest"), "models"), "content_digest")
    texts = segment_texts(due, block).join(per_segment, F.col("content_digest") == F.col("segment_digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests, sizes, lists = [], [], [], []
            for digest, text, models in zip(*(c.to_pylist() for c in batch.columns)):
                for m in sorted(models, key=lambda m: m["model_key"]):
                    cut = pieces(text, m["max_chars"], m["overlap_chars"])
                    keys.append(m["model_key"])
                    digests.append(digest)
                    sizes.append(len(text))
                    lists.append([{"start": s, "core": c, "end": e, "cut": k, "text": text[s:e] if with_text else None} for s, c, e, k in cut])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("core", pa.int32()), ("end", pa.int32()), ("cut", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string()), pa.array(sizes, pa.int32()), pa.array(lists, kind)], names=["model_key", "segment_digest", "n_chars", "pieces"])

    return texts.select("segment_digest", "text", "models").mapInArrow(run, f"model_key string, segment_digest string, n_chars int, pieces {_PIECE}")


def oversized(split: DataFrame) -> DataFrame:
    """(model_key, segment_digest, forced) of the keys that came out in more than one piece; forced: one was cut inside a stretch."""
    return split.where(F.size("pieces") > 1).select("model_key", "segment_digest", F.exists("pieces", lambda p: p["cut"] == "forced").cast("int").alias("forced"))
