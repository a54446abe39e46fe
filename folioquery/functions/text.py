"""Text functions. Those that Spark can express are Columns; Unicode normal forms need Python over Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

WORD = r"[\p{L}\p{N}]+"
#: Rounds after which folding has come to rest.
FOLD_ROUNDS = 6


def fold_key(text: str) -> str:
    """A blocking key: case and compatibility folded to rest, runs of other characters as one underscore, none at the ends."""
    for _ in range(FOLD_ROUNDS):
        folded = unicodedata.normalize("NFKC", text.casefold())
        if folded == text:
            break
        text = folded
    return re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", text)).strip("_")


@F.arrow_udf(StringType())
def fold_keys(column: pa.Array) -> pa.Array:
    seen: dict[str, str] = {}
    return pa.array([None if t is None else seen[t] if t in seen else seen.setdefault(t, fold_key(t)) for t in column.to_pylist()], type=pa.string())


def normalize_key(text: Column) -> Column:
    """fold_key() of a column; plain ASCII never leaves the JVM."""
    ascii_key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_"), "_+", "_"), F.lit("_"))
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, ascii_key).otherwise(fold_keys(F.when(~plain, text)))


@F.arrow_udf(StringType())
def nfc(column: pa.Array) -> pa.Array:
    """Canonical composition."""
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in column.to_pylist()], type=pa.string())


@F.arrow_udf(StringType())
def strip_accents(column: pa.Array) -> pa.Array:
    """Lower case without diacritics, as an index term."""
    out = []
    for t in column.to_pylist():
        if t is not None and not t.isascii():
            t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
        out.append(None if t is None else t.lower())
    return pa.array(out, type=pa.string())


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def ngrams(text: Column, n: int) -> Column:
    """All runs of n characters, in order; empty for shorter texts."""
    count = F.char_length(text) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, n: int = 3) -> Column:
    """The set of n-character shingles of a text without its separators."""
    return F.array_distinct(ngrams(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), n))


def token_cost(text: Column) -> Column:
    """Tokens charged for a text: a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; null for an empty text."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    size = F.size(characters)
    each = F.transform(F.array_distinct(characters), lambda c: F.size(F.filter(characters, lambda x: x == c)) / size)
    return F.when(size > 0, F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def section_path(numbers: Column) -> Column:
    """Section numbers [1, 4, 2] as the sortable path /0001/0004/0002."""
    return F.concat(F.lit("/"), F.array_join(F.transform(numbers, lambda x: F.lpad(x.cast("string"), 4, "0")), "/"))


def prefix_range(path: Column, prefix: str) -> Column:
    """Whether a path lies under a prefix, as a half-open range that parquet can prune by."""
    return (path >= prefix) & (path < prefix[:-1] + chr(ord(prefix[-1]) + 1)) if prefix else F.lit(True)


def title_key(c: Column) -> Column:
    """The key of a title without a trip to Python: lower case, runs of anything but letters, marks, digits and _ as one _."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{M}\\p{N}]+", "_"), F.lit("_"))


def title_grade(title: Column, wanted: Column) -> Column:
    """How well a title answers a wanted one: 45 the same but for case, 40 the same key, 30 one begins with the other, 0 not; an empty title never."""
    low, want = F.lower(title), F.lower(wanted)
    prefix = F.startswith(low, want) | F.startswith(want, low)
    return F.when(F.char_length(title) == 0, 0).when(low == want, 45).when(title_key(title) == title_key(wanted), 40).when(prefix, 30).otherwise(0)


def data_type(text: Column) -> Column:
    """The type a table cell's text shows."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "xsd:date")
        .when(t.rlike(r"^(EUR|USD|GBP|CHF|JPY)\s?-?\d+([.,]\d+)?$"), F.concat(F.lit("money:"), F.substring(t, 1, 3)))
        .when(t.rlike(r"^-?\d+([.,]\d+)?$"), "xsd:decimal")
        .otherwise("string")
    )


def fold_view(text: str) -> tuple[str, list[int]]:
    """A text folded for quoting, and for each of its characters the place it came from."""
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        if c == "­":
            continue
        for x in unicodedata.normalize("NFKC", c).casefold():
            kind = unicodedata.category(x)
            if kind == "Cf":
                continue
            x = "-" if kind == "Pd" else '"' if x in "“”„«»" else "'" if x in "‘’‚" else " " if x.isspace() else x
            if x == " " and (not out or out[-1] == " "):
                continue
            out.append(x)
            at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


@F.arrow_udf(StringType())
def fold_text(column: pa.Array) -> pa.Array:
    """fold_view() without the places."""
    return pa.array([None if t is None else fold_view(t)[0] for t in column.to_pylist()], type=pa.string())


_VIEW = StructType([StructField("text", StringType()), StructField("places", ArrayType(IntegerType()))])


@F.arrow_udf(_VIEW)
def fold_views(column: pa.Array) -> pa.Array:
    """fold_view() of a column."""
    views = [None if t is None else fold_view(t) for t in column.to_pylist()]
    return pa.array([None if v is None else {"text": v[0], "places": v[1]} for v in views], type=pa.struct([("text", pa.string()), ("places", pa.list_(pa.int32()))]))


def strip_markdown(c: Column) -> Column:
    """A text without Markdown's line marks, links and emphasis, runs of white space as one space; letter case stays."""
    c = F.regexp_replace(c, r"(?m)^ {0,3}(#{1,6}|>|[-*+]|[0-9]+\.)[ \t]+", "")
    c = F.regexp_replace(c, r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[*_`]{1,3}", ""), r"[ \t\n\r]+", " "))


def parse_duration(duration: str) -> int:
    """Seconds of `<n>m`, `<n>h` or `<n>d`."""
    m = re.fullmatch(r"(\d+)([mhd])", duration.strip())
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    return int(m[1]) * {"m": 60, "h": 3600, "d": 86400}[m[2]]
