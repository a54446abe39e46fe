"""String similarity: Jaro-Winkler, token edit distance, fuzzy containment; vector signatures, products and MinHash as Columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def jaro(a: str, b: str) -> float:
    """Jaro similarity in [0, 1]."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left: list[str] = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
        if j is not None:
            taken[j] = True
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a common prefix of up to four characters."""
    base = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return base + same * 0.1 * (1 - base)


def edit_distance(a: list | str, b: list | str) -> int:
    """Levenshtein distance of two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fuzzy_ends(needle: str, text: str, max_diffs: int) -> list[tuple[int, int]]:
    """(end, differences) of every place in text where the needle ends with at most max_diffs edits."""
    row = list(range(len(needle) + 1))
    out = [(0, row[-1])] if row[-1] <= max_diffs else []
    for end, c in enumerate(text, 1):
        last, row[0] = row[0], 0
        for j, x in enumerate(needle, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != c))
        if row[-1] <= max_diffs:
            out.append((end, row[-1]))
    return out


def fuzzy_least(needle: str, text: str) -> int:
    """The least differences of all fuzzy_ends(): Myers' bit vectors, one step a character of the text whatever the needle's length."""
    if needle in text:
        return 0
    m = len(needle)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for j, c in enumerate(needle):
        at[c] = at.get(c, 0) | 1 << j
    up, down, now, best = full, 0, m, m
    for c in text:
        eq = at.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(horizontal | up) & full, up & horizontal
        if more & top:
            now += 1
        elif less & top:
            now -= 1
            if now < best:
                best = now
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(vertical | more) & full, more & vertical
    return best


def _pairs(f, kind: pa.DataType):
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else f(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())], type=kind)

    return run


@F.arrow_udf(DoubleType())
def jaro_winkler_score(left: pa.Array, right: pa.Array) -> pa.Array:
    """Jaro-Winkler of two columns on a scale of 100."""
    return _pairs(lambda a, b: round(100 * jaro_winkler(a, b), 4), pa.float64())(left, right)


@F.arrow_udf(DoubleType())
def jaro_score(left: pa.Array, right: pa.Array) -> pa.Array:
    """Jaro of two columns on a scale of 100."""
    return _pairs(lambda a, b: round(100 * jaro(a, b), 4), pa.float64())(left, right)


@F.arrow_udf(DoubleType())
def agreement(left: pa.Array, right: pa.Array) -> pa.Array:
    """One less the word edit distance over the longer word count; null when neither has a word."""

    def score(a: str, b: str) -> float | None:
        x, y = a.split(), b.split()
        return 1 - edit_distance(x, y) / max(len(x), len(y)) if x or y else None

    return _pairs(score, pa.float64())(left, right)


@F.arrow_udf(IntegerType())
def least_diffs(needle: pa.Array, text: pa.Array) -> pa.Array:
    """The least number of edits with which the needle occurs in the text."""
    return _pairs(fuzzy_least, pa.int32())(needle, text)


def signature(vector: Column) -> Column:
    """One sign bit per dimension, sixty-four to a BIGINT, as an ARRAY<BIGINT>; every dimension counts."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(vector), F.lit(1)), F.lit(64))
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    return F.transform(starts, lambda s: F.aggregate(F.transform(F.slice(vector, s, F.lit(64)), bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signatures of the same width."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine; null if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def minhash(shingle_set: Column, permutations: int) -> Column:
    """The least hash of a shingle set under each of `permutations` seeded hash functions."""
    seeds = F.array(*[F.lit(i) for i in range(permutations)])
    return F.transform(seeds, lambda s: F.array_min(F.transform(shingle_set, lambda x: F.xxhash64(s, x))))


def band_keys(signature_: Column, bands: int, rows: int) -> Column:
    """(band, bucket) structs of a MinHash signature."""
    cuts = F.sequence(F.lit(0), F.lit(bands - 1))
    # The signature is bound once by the outer lambda: inside the inner one it would be computed again for every band.
    return F.flatten(F.transform(F.array(signature_), lambda m: F.transform(cuts, lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice(m, b * rows + 1, F.lit(rows))).alias("bucket")))))
