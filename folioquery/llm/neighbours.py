"""Problem 3: the k most similar vectors (cosine) of every vector, by shifted space-filling curves.

Per model, vectors are projected on the leading principal axes of a bounded sample; each curve turns these by a rotation of its own,
maps eight coordinates to even quantiles, shifts them and takes the Hilbert key. Rows are range-partitioned by (model, curve,
key), each range with a halo of its neighbours' nearest rows, so that the window of WINDOW rows in key order on either side is whole at a
range's ends too. Within a window rows are compared by vectors coded as a byte a dimension, which is what is shuffled; the lists
of all curves merge by number, and what the coding cannot tell apart goes on to the exact rerank, a join to the stored
vectors. Only the axes, quantiles and range bounds come from the sample (SAMPLE_ROWS a model, chosen by hash); every row is indexed.

Exact copies of a vector are one class: the curve holds it once, with its k + 1 least digests, which are all that can be among the
k most similar of any row (ties go to the lesser digest).

Defined results: a vector that is null, of a wrong length, not finite or all zero has no neighbours and is nobody's; a digest counts
once per model (of different vectors the least); a model unknown to embed_space has no neighbours; fewer than k others give fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import cut, store

TOP = 10
CURVES = 10
WINDOW = 256
WIDE_WINDOW = 2048
SAMPLE_ROWS = 8192
AXES = 24
COORDINATES, BITS = 8, 7
ROWS_PER_RANGE = 20_000
BLOCK = 512
SEED = 20_011


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows x dimensions, below 2^bits), by the transposed Gray code."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one, bit = np.uint64(1), np.uint64(1) << np.uint64(bits - 1)
    top = bit
    while bit > one:
        low = bit - one
        for i in range(len(x)):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        bit >>= one
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    gray, bit = np.zeros_like(x[0]), top
    while bit > one:
        gray = np.where((x[-1] & bit) != 0, gray ^ (bit - one), gray)
        bit >>= one
    key = np.zeros_like(gray)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << one | ((axis ^ gray) >> np.uint64(b)) & one
    return key.astype(np.int64)


class Curves:
    """The fitted curves of one model. A range is extended at either end by a halo of about `halo` rows, by the sample's quantiles."""

    def __init__(self, sample: np.ndarray, rows: int, curves: int, first_range: int, halo: int) -> None:
        self.mean = sample.mean(axis=0)
        axes = np.linalg.svd(sample - self.mean, full_matrices=False)[2][:AXES]
        rng = np.random.default_rng(SEED)
        self.maps, self.grids, self.shifts, self.bounds, self.halos, self.first = [], [], [], [], [], []
        ranges = max(1, -(-rows // ROWS_PER_RANGE))
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0]
            self.maps.append((axes.T @ turn)[:, : min(COORDINATES, len(axes))].astype(np.float32))
            self.grids.append(np.sort((sample - self.mean) @ self.maps[-1], axis=0))
            self.shifts.append(rng.random(self.maps[-1].shape[1]))
            self.first.append(first_range)
            first_range += ranges
            keys = np.sort(self.keys(sample, len(self.bounds)))
            at = np.array([len(keys) * i / ranges for i in range(1, ranges)])
            place = np.arange(len(keys))
            self.bounds.append(np.interp(at, place, keys).astype(np.int64))
            wide = halo * len(keys) / max(rows, 1)
            self.halos.append((np.interp(at - wide, place, keys).astype(np.int64), np.interp(at + wide, place, keys).astype(np.int64)))
        self.end = first_range

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        y = (x - self.mean) @ self.maps[curve]
        grid = self.grids[curve]
        u = np.stack([np.searchsorted(grid[:, j], y[:, j]) for j in range(y.shape[1])], axis=1) / len(grid)
        cells = ((u + self.shifts[curve]) / 2 * (1 << BITS)).astype(np.int64)
        return hilbert_keys(np.minimum(cells, (1 << BITS) - 1), BITS)

    def places(self, keys: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, range, in the halo) of keys on a curve: each row in its own range, and in the halo of the next ones near a bound."""
        own = np.searchsorted(self.bounds[curve], keys, side="right")
        low, high = self.halos[curve]
        # A key from `low` of a bound on is seen by the range above it, one below `high` by the range under it.
        up, down = np.searchsorted(low, keys, side="right"), np.searchsorted(high, keys, side="right")
        rows, ranges, halo = [np.arange(len(keys))], [own], [np.zeros(len(keys), bool)]
        for near in (np.minimum(up, own + 1), np.maximum(down, own - 1)):
            other = np.flatnonzero(near != own)
            rows.append(other)
            ranges.append(near[other])
            halo.append(np.ones(len(other), bool))
        return np.concatenate(rows), self.first[curve] + np.concatenate(ranges), np.concatenate(halo)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as float32 rows of length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def clean_vectors(vectors: DataFrame, space: DataFrame) -> DataFrame:
    """(model_key, digest, v): usable vectors, each digest once per model."""
    dims = space.select("model_key", "dim").distinct()
    valid = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.join(dims, "model_key").where(F.col("segment_digest").isNotNull() & (F.size("v") == F.col("dim")) & valid)
    return rows.groupBy("model_key", F.col("segment_digest").alias("digest")).agg(F.min("v").alias("v"))


def copy_classes(clean: DataFrame, top: int) -> DataFrame:
    """(model_key, rep, member, v): of each class of exact copies the top + 1 least digests; rep is the least, v stands on its row only."""
    same = Window.partitionBy("model_key", "h1", "h2").orderBy("digest")
    ranked = clean.select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).withColumn("at", F.row_number().over(same)).where(F.col("at") <= top + 1)
    named = ranked.withColumn("rep", F.first("digest").over(same))
    return named.select("model_key", "rep", F.col("digest").alias("member"), F.when(F.col("at") == 1, F.col("v")).alias("v"))


def numbered(classes: DataFrame) -> DataFrame:
    """The representatives with a number each, (model_key, rep, n, v), written once: what is shuffled later carries eight bytes, not digests."""
    return store(classes.where("v IS NOT NULL").select("model_key", "rep", F.monotonically_increasing_id().alias("n"), "v"))


def curve_count(rows: int, curves: int) -> int:
    """The curves of a model: `curves` up to 100,000 rows, and six in ten more for each doubling, as a window is an ever smaller part of the rows."""
    return max(curves, ceil(curves * (1 + 0.6 * log2(max(rows, 1) / 100_000))))


def fit(reps: DataFrame, curves: int, halo: int) -> tuple[dict[str, Curves], int]:
    """The curves of each model and the number of ranges, from a sample of bounded size: one job for counts, one for all samples."""
    counts = {r["model_key"]: r["n"] for r in reps.groupBy("model_key").agg(F.count("*").alias("n")).collect()}  # a row a model
    if not counts:
        return {}, 1
    share = F.create_map(*[F.lit(x) for m, n in counts.items() for x in (m, int(1_000_000 * min(1.0, SAMPLE_ROWS / n)) + 1)])
    chosen = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < F.element_at(share, F.col("model_key")))
    sample = chosen.select("model_key", "v").limit(2 * SAMPLE_ROWS * len(counts)).toArrow()
    out, at = {}, 0
    for model in sorted(counts):
        own = sample.filter(pc.equal(sample.column(0), model)).column(1).combine_chunks()
        out[model] = Curves(unit_rows(own) if len(own) else np.zeros((1, 1), np.float32), counts[model], curve_count(counts[model], curves), at, halo)
        at = out[model].end
    return out, max(1, at)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as one signed byte a dimension and a scale each."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


#: A cosine of coded vectors differs from the exact one by less; rows within it of the last place kept are kept as well.
CODE_ERROR = 0.004
_KEYED = "id bigint, scale float, code binary, model int, range int, key bigint, halo boolean"


def keyed_rows(reps: DataFrame, fitted: dict[str, Curves], models: list[str]) -> DataFrame:
    """Each numbered representative on every curve, its vector as coded bytes."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model in batch.column(0).unique().to_pylist():
                own = batch.filter(pc.equal(batch.column(0), model))
                x, m = unit_rows(own.column(2)), fitted[model]
                code, scale = coded(x)
                binary = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, code.size + 1, x.shape[1], dtype=np.int32)), pa.py_buffer(code)])
                for c in range(len(m.maps)):
                    keys = m.keys(x, c)
                    row, ranged, halo = m.places(keys, c)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([own.column(1).take(take), pa.array(scale[row]), binary.take(take), pa.array(np.full(len(row), models.index(model), np.int32)), pa.array(ranged.astype(np.int32)), pa.array(keys[row]), pa.array(halo)], names=["id", "scale", "code", "model", "range", "key", "halo"])

    return reps.select("model_key", "n", "v").mapInArrow(key, _KEYED)


def window_lists(keyed: DataFrame, ranges: int, top: int, window: int, least: float) -> DataFrame:
    """(a, near ARRAY<STRUCT<c FLOAT, b BIGINT>>): for every row of every curve its best `top` of the window on either side, by coded vectors, and
    those that the coding cannot tell from the last of them; each row of a range is one row of the result, however many it has found."""
    slack = 2 * CODE_ERROR

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in key order by range; at most the window around a block is held."""
        here, ids, halo, x, done = None, None, None, None, 0

        def block(until: int) -> pa.RecordBatch | None:
            low, high = max(0, done - window), min(len(x), until + window)
            mine = done + np.flatnonzero(~halo[done:until])
            if not len(mine) or high - low < 2:
                return None
            s = x[mine] @ x[low:high].T
            s[np.arange(len(mine)), mine - low] = -2
            k = min(top, s.shape[1])
            last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            i, j = np.nonzero(s >= np.maximum(last - slack if least > -1 else last, least - CODE_ERROR)[:, None])
            keep = s[i, j] > -2
            i, j = i[keep], j[keep]
            near = pa.StructArray.from_arrays([pa.array(s[i, j].astype(np.float32)), pa.array(ids[low + j])], names=["c", "b"])
            sizes = np.searchsorted(i, np.arange(len(mine) + 1)).astype(np.int32)
            full = np.diff(sizes) > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.ListArray.from_arrays(sizes, near)], names=["a", "near"]).filter(pa.array(full))

        def drain(until: int) -> Iterator[pa.RecordBatch]:
            nonlocal done
            while x is not None and done < until:
                end = min(until, done + BLOCK)
                out = block(end)
                if out is not None and out.num_rows:
                    yield out
                done = end

        for batch in batches:
            place = batch.column(4).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(place)) + 1, len(place)]
            for at, end in zip(cuts[:-1], cuts[1:]) if len(place) else []:
                part = batch.slice(at, end - at)
                code = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.int8).reshape(len(part), -1)
                v = code.astype(np.float32) * part.column(1).to_numpy()[:, None]
                n, h = part.column(0).to_numpy(), part.column(6).to_numpy(zero_copy_only=False).astype(bool)
                if here != int(place[at]):
                    if x is not None:
                        yield from drain(len(x))
                    here, ids, halo, x, done = int(place[at]), n, h, v, 0
                else:
                    ids, halo, x = np.concatenate([ids, n]), np.concatenate([halo, h]), np.concatenate([x, v])
                while len(x) >= done + BLOCK + window:
                    yield from drain(done + BLOCK)
                if done > window + 16 * BLOCK:
                    gone = done - window
                    ids, halo, x, done = ids[gone:].copy(), halo[gone:].copy(), x[gone:].copy(), window
        if x is not None:
            yield from drain(len(x))

    ordered = keyed.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "id")
    return ordered.mapInArrow(compare, "a bigint, near array<struct<c:float,b:bigint>>")


def merged_lists(lists: DataFrame, top: int) -> DataFrame:
    """(a, near): the lists of all curves as one, each neighbour once, the best by coded cosine and those within the coding's error of the last place."""
    slack = 2 * CODE_ERROR

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            i = np.repeat(np.arange(len(rows)), sizes)
            c, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            order = np.lexsort((-c, b, i))
            i, c, b = i[order], c[order], b[order]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1]) | (b[1:] != b[:-1])
            i, c, b = i[first], c[first], b[first]
            order = np.lexsort((b, -c, i))
            i, c, b = i[order], c[order], b[order]
            start = np.searchsorted(i, np.arange(len(rows)))
            count = np.searchsorted(i, np.arange(len(rows)), side="right") - start
            last = np.where(count > top, c[np.minimum(start + top - 1, max(len(c) - 1, 0))], -2) if len(c) else np.zeros(len(rows))
            keep = c >= last[i] - slack
            i, c, b = i[keep], c[keep], b[keep]
            near = pa.StructArray.from_arrays([pa.array(c), pa.array(b)], names=["c", "b"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.searchsorted(i, np.arange(len(rows) + 1)).astype(np.int32), near)], names=["a", "near"])

    gathered = lists.groupBy("a").agg(F.flatten(F.collect_list("near")).alias("near"))  # a list a curve
    return gathered.mapInArrow(merge, "a bigint, near array<struct<c:float,b:bigint>>")


@F.arrow_udf(DoubleType())
def exact_cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """The cosine of unit rows in float64: the same for a pair whichever side it is asked from."""
    out = np.empty(len(left))
    lengths = np.asarray(pc.list_value_length(left).to_numpy(zero_copy_only=False))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        take = pa.array(at)
        out[at] = np.einsum("ij,ij->i", *(unit_rows(x.take(take)).astype(np.float64) for x in (left, right)))
    return pa.array(out)


def exact_pairs(reps: DataFrame, lists: DataFrame, both: bool) -> DataFrame:
    """(model_key, a, b, cos) in both directions: the listed pairs, named by their representatives, with the exact cosine, which is computed once
    a pair. both: only pairs that stand in the lists of both sides."""
    listed = lists.select("a", F.explode("near.b").alias("b")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("sides"))
    pairs = listed.where("sides = 2" if both else "sides > 0").select("a", "b")
    left = reps.select(F.col("n").alias("a"), F.col("rep").alias("rep_a"), F.col("v").alias("v_a"))
    right = reps.select("model_key", F.col("n").alias("b"), F.col("rep").alias("rep_b"), F.col("v").alias("v_b"))
    met = pairs.join(left, "a").join(right, "b").select("model_key", "rep_a", "rep_b", exact_cosine("v_a", "v_b").alias("cos"))
    directions = F.explode(F.array(F.struct(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), F.struct(F.col("rep_b").alias("a"), F.col("rep_a").alias("b"))))
    return met.select("model_key", "cos", directions.alias("p")).select("model_key", "p.a", "p.b", "cos")


def curve_pairs(reps: DataFrame, top: int, curves: int, window: int, least: float, both: bool = False) -> DataFrame:
    """(model_key, a, b, cos) in both directions: for every class a, at least its best `top` classes b of its windows on all curves with
    cosine >= least, with the exact cosine; both: only if a is in b's list too. reps as numbered() gives them."""
    fitted, ranges = fit(reps, curves, window)
    lists = merged_lists(window_lists(keyed_rows(reps, fitted, sorted(fitted)), ranges, top, window, least), top)
    return exact_pairs(reps, lists, both)


def member_lists(pairs: DataFrame, classes: DataFrame, top: int) -> DataFrame:
    """(model_key, a, b, cos): for each class a, the top + 1 best digests b, its own members among them."""
    members = classes.select("model_key", F.col("rep").alias("b"), "member")
    near = pairs.join(members, ["model_key", "b"]).select("model_key", "a", F.col("member").alias("b"), "cos")
    own = classes.select("model_key", F.col("rep").alias("a"), F.col("member").alias("b"), F.lit(1.0).alias("cos"))
    best = Window.partitionBy("model_key", "a").orderBy(F.col("own").desc(), F.col("cos").desc(), "b")
    both = near.withColumn("own", F.lit(False)).unionByName(own.withColumn("own", F.lit(True)))
    return both.withColumn("at", F.row_number().over(best)).where(F.col("at") <= top + 1).select("model_key", "a", "b", "cos", "at")


def neighbours(vectors: DataFrame, space: DataFrame, top: int = TOP, curves: int = CURVES, window: int = WIDE_WINDOW) -> DataFrame:
    """(model_key, segment_digest, neighbour, cos, rank): the `top` most similar of every usable vector."""
    clean = cut(clean_vectors(vectors, space))
    classes = cut(copy_classes(clean, top))
    lists = member_lists(curve_pairs(numbered(classes), top, curves, window, -1.0), classes, top)
    per_class = lists.groupBy("model_key", "a").agg(F.array_sort(F.collect_list(F.struct("at", "b", "cos"))).alias("l"))
    # Every member of a class, the ones beyond its least digests too, has the list of the class without itself.
    first = classes.where("v IS NOT NULL").select("model_key", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.col("rep").alias("a"))
    rows = clean.select("model_key", "digest", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).join(first, ["model_key", "h1", "h2"])
    out = rows.join(per_class, ["model_key", "a"]).select("model_key", F.col("digest").alias("segment_digest"), F.slice(F.filter("l", lambda x: x["b"] != F.col("digest")), 1, top).alias("l"))
    return out.select("model_key", "segment_digest", F.posexplode("l").alias("p", "n")).select("model_key", "segment_digest", F.col("n.b").alias("neighbour"), "n.cos", (F.col("p") + 1).alias("rank"))


def mutual_pairs(vectors: DataFrame, space: DataFrame, least: float, top: int = TOP, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """(model_key, segment_digest_a, segment_digest_b), a < b: each among the other's `top` most similar, with cosine >= least.

    Vectors below `least` cannot come before such a pair in either list, so they are left out of the lists. Of a class of
    copies only the top + 1 least digests can be in a mutual pair: the lists of the others are full of those, which do not return it.
    """
    classes = cut(copy_classes(clean_vectors(vectors, space), top))
    pairs = curve_pairs(numbered(classes), top, curves, window, least - 1e-4, both=True).where(F.col("cos") >= least - 1e-7)
    lists = member_lists(pairs, classes, top)
    lone = classes.groupBy("model_key", F.col("rep").alias("a")).agg(F.collect_set("member").alias("members"))
    directed = lists.join(lone, ["model_key", "a"]).select("model_key", F.explode("members").alias("x"), "b", "at").where("x <> b")
    mine = Window.partitionBy("model_key", "x").orderBy("at")
    kept = directed.withColumn("r", F.row_number().over(mine)).where(F.col("r") <= top)
    both = kept.groupBy("model_key", F.least("x", "b").alias("segment_digest_a"), F.greatest("x", "b").alias("segment_digest_b")).agg(F.count("*").alias("n"))
    return both.where("n = 2").drop("n")
