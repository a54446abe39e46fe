"""Problem 2: one consistent form for text that looks the same but holds different characters.

Step 1, in SQL: every value is mapped by look (width forms, spaces, hyphens, ligatures, letters of another script with the same
shape; invisible characters go). Step 2: the mapped values are grouped under the accent-sensitive, case-sensitive Unicode
collation, under which the ways to write an accent are equal. Step 3: a member of each class is chosen as its canonical form and joined back
to the values: the one with the fewest words of mixed scripts, then the fewest characters that a plainer one stands for, then
the least. The mapped form is a key only; a text in one script stays in it.

Letter case, raised digits, accents, and any other letter or digit stay different. Defined results: null has the null form; the
empty text and a text of nothing but invisible characters share one form, the empty one if it occurs; repeated rows keep their number.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

COLLATION = "UNICODE"

# Letters of other scripts whose shape is that of a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ", "ABESIJKMHOPCTYXaesijopcyxdhqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
CYRILLIC_MORE = dict(zip("һӀӏѴѵԌҮү", "hIlVvGYy"))
GREEK_MORE = dict(zip("ϜͿϹ", "FJC"))
ARMENIAN = dict(zip("ՕՍՏԼօսոհցզյ", "OUSLounhgqj"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏟᏒᏔᏕᏙᏚᏞᏢᏦᏴᎥᏏ", "DRTAJEWMHGZCRWSVSLPKBib"))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
SAME_SHAPE = CYRILLIC | GREEK | CYRILLIC_MORE | GREEK_MORE | ARMENIAN | CHEROKEE | COPTIC | LISU
# Hyphens that look like the ASCII one.
HYPHENS = "‐‑﹣－"


@cache
def look_table() -> tuple[dict[str, str], dict[str, str]]:
    """(one character to at most one, one character to several): the mapping by look, from rules over the code points."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}

    def put(c: str, to: str) -> None:
        if to != c:
            (single if len(to) < 2 else several)[c] = to

    shape = str.maketrans(SAME_SHAPE)
    for code in [*range(0x00, 0x20), *range(0x7F, 0xA0)]:
        if chr(code) not in "\t\n\r\x85":
            put(chr(code), "")
    # Beyond the basic plane: mathematical letters, tags and selectors without a look.
    for code in [*range(0xA0, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)]:
        if 0xD800 <= code < 0xF900 or 0x3400 <= code < 0xA000 or 0xAC00 <= code < 0xD7A4:
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" and not 0x600 <= code <= 0x605 or code == 0x34F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code:
            put(c, "")
        elif kind == "Zs":
            put(c, " ")
        elif c in HYPHENS:
            put(c, "-")
        elif 0xFF00 <= code <= 0xFFEF or 0xFB00 <= code <= 0xFB06 or 0xFB50 <= code <= 0xFDFF or 0xFE70 <= code <= 0xFEFF:
            # Width forms, Latin and Arabic ligatures and positional forms; marks that would stand on a space stay as they are.
            to = "゙" if code == 0xFF9E else "゚" if code == 0xFF9F else unicodedata.normalize("NFKC", c)
            put(c, c if " " in to and len(to) > 1 else to)
        elif 0x2160 <= code <= 0x217F or unicodedata.decomposition(c).startswith("<font>"):
            # Roman numerals and letters of a mathematical font are the letters they are made of.
            put(c, unicodedata.normalize("NFKC", c).translate(shape))
        elif 0x370 <= code < 0x590 or 0x1F00 <= code < 0x2000 or c in SAME_SHAPE:
            put(c, unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).translate(shape)))
    return single, several


#: Text of printable ASCII is its own mapped form.
PLAIN = r"^[\x20-\x7e\n\r\t]*$"


def by_look(text: Column) -> Column:
    """The text mapped by look, inside the JVM; plain ASCII is passed through."""
    single, several = look_table()
    keep = [c for c in single if single[c]]
    gone = [c for c in single if not single[c]]
    out = F.translate(text, "".join(keep + gone), "".join(single[c] for c in keep))

    def spell_out(x: Column) -> Column:
        many = x
        for c in SEVERAL:
            many = F.replace(many, F.lit(c), F.lit(several[c]))
        return F.when(x.rlike(_SEVERAL_CLASS), many).otherwise(x)

    # The lambda binds the translated text, so that it is computed once though used twice.
    return F.when(text.rlike(PLAIN), text).otherwise(F.get(F.transform(F.array(out), spell_out), 0))


#: Characters with a mapping to several that are replaced: Latin ligatures, lam-alef ligatures and the accented letters of other scripts.
SEVERAL = [c for c in look_table()[1] if 0xFB00 <= ord(c) <= 0xFB06 or 0xFEF5 <= ord(c) <= 0xFEFC or ord(c) < 0x590 or 0x2160 <= ord(c) <= 0x217F]


def _ranges(characters: list[str]) -> str:
    """A pattern's class of the characters as ranges: single ones are tried one after another at every character of a text."""
    out: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if out and code <= out[-1][1] + 8:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


#: Texts that may hold one of them; the ranges close small gaps.
_SEVERAL_CLASS = _ranges(SEVERAL)


@cache
def base_table() -> tuple[str, str]:
    """Arguments of translate() that take accents off: composed characters to their base, combining marks to nothing."""
    base, marks = {}, []
    for code in range(0xA0, 0x10000):
        if 0xAC00 <= code < 0xE000:
            continue
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif (d := unicodedata.normalize("NFD", c)) != c:
            base[c] = d[0]
    return "".join([*base, *marks]), "".join(base.values())


def skeleton_hash(mapped: Column) -> Column:
    """A hash that members of a class share, as they differ in the writing of accents only: it spares most comparisons by collation."""
    bare = F.when(mapped.rlike(PLAIN), mapped).otherwise(F.translate(mapped, *base_table()))
    return F.xxhash64(bare)


def look_key(mapped: Column) -> list[Column]:
    return [F.xxhash64(mapped).alias("k1"), F.xxhash64(F.lit(1), mapped).alias("k2")]


@cache
def _python_table() -> dict[int, str]:
    single, several = look_table()
    return str.maketrans(single | {c: several[c] for c in SEVERAL})


def composed(text: str) -> str:
    """The mapped text in canonical composition."""
    return unicodedata.normalize("NFC", text.translate(_python_table()))


@F.arrow_udf(StringType())
def _checked(mapped: pa.Array, canonical: pa.Array) -> pa.Array:
    """Exact check of members that the collation calls equal to a canonical form: it, or their own composed form if they are not."""
    return pa.array([None if m is None else c if composed(m) == composed(c) else composed(m) for m, c in zip(mapped.to_pylist(), canonical.to_pylist())], type=pa.string())


def canonical_classes(mapped: DataFrame) -> DataFrame:
    """(k1, k2, canonical) of distinct mapped values (one string column): k1, k2 hash the value, canonical is its class's least member.

    Copies are taken out before values are grouped; only members that differ from their canonical form go to the exact check.
    """
    (column,) = mapped.columns
    values = mapped.select(F.col(column).alias("m")).distinct().withColumns({"sk": skeleton_hash(F.col("m")), "class": F.collate("m", COLLATION)})
    least = values.withColumn("c", F.min("m").over(Window.partitionBy("sk", "class"))).select(*look_key(F.col("m")), "c", F.when(F.col("m") != F.col("c"), F.col("m")).alias("other"))
    checked = _checked(F.col("other"), F.when(F.col("other").isNotNull(), F.col("c")))
    return least.select("k1", "k2", F.coalesce(checked, "c").alias("canonical"))


def odd_characters() -> str:
    """Characters that a plainer one stands for: all of the mapping but letters of other scripts."""
    return "".join(c for c in [*look_table()[0], *SEVERAL] if c not in SAME_SHAPE and not 0x370 <= ord(c) < 0x590)


def oddity(text: Column) -> Column:
    """(words of mixed scripts, characters that a plainer one stands for, combining marks): of members of a class the least is the plainest."""
    other = "\\p{IsCyrillic}\\p{IsGreek}\\p{IsArmenian}\\p{IsCherokee}\\p{IsCoptic}\\p{IsLisu}"
    mixed = F.size(F.regexp_extract_all(text, F.lit(f"(?:\\p{{IsLatin}}[\\p{{L}}\\p{{M}}]*[{other}]|[{other}][\\p{{L}}\\p{{M}}]*\\p{{IsLatin}})"), F.lit(0)))
    measured = F.struct(mixed.alias("mixed"), (F.char_length(text) - F.char_length(F.translate(text, odd_characters(), ""))).alias("odd"), F.regexp_count(text, F.lit("\\p{Mn}")).alias("marks"))
    return F.when(text.rlike(PLAIN), F.struct(F.lit(0).alias("mixed"), F.lit(0).alias("odd"), F.lit(0).alias("marks"))).otherwise(measured)


def canonical_members(texts: DataFrame) -> DataFrame:
    """(k1, k2, form) of the texts (one string column, no nulls): k1, k2 hash the mapped text, form is the member its class is written as.

    A mapped value hands on its plainest text only, so that copies and variants meet before the classes are shuffled.
    """
    (column,) = texts.columns
    t = F.col(f"`{column}`")
    keyed = texts.select(t.alias("t"), F.get(F.transform(F.array(by_look(t)), lambda m: F.struct(*look_key(m))), 0).alias("ks"))
    values = keyed.groupBy("ks.k1", "ks.k2").agg(F.min(F.struct(oddity(F.col("t")).alias("o"), "t")).alias("best"))
    classes = canonical_classes(values.select(by_look(F.col("best.t")).alias("m"))).select("k1", "k2", F.xxhash64("canonical").alias("c1"), F.xxhash64(F.lit(1), "canonical").alias("c2"))
    members = values.join(classes, ["k1", "k2"])
    forms = members.groupBy("c1", "c2").agg(F.min("best").alias("best")).select("c1", "c2", F.col("best.t").alias("form"))
    return classes.join(forms, ["c1", "c2"]).select("k1", "k2", "form")


def canonical_form(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """df with one more column, the consistent form of `column`, which is one of its values; its rows are kept, with their number. A column
    named `out` is replaced."""
    own = {n: n for n in ("_k1", "_k2", "_q1", "_q2", "_form")}
    while set(own.values()) & set(df.columns):
        own = {n: "_" + x for n, x in own.items()}
    quoted = F.col(f"`{column}`")
    classes = canonical_members(df.where(quoted.isNotNull()).select(quoted)).withColumnsRenamed({"k1": own["_k1"], "k2": own["_k2"], "form": own["_form"]})
    keyed = df.withColumns(dict(zip((own["_q1"], own["_q2"]), look_key(by_look(quoted)))))
    joined = keyed.join(classes, (F.col(own["_q1"]) == F.col(own["_k1"])) & (F.col(own["_q2"]) == F.col(own["_k2"])), "left")
    form = F.when(quoted.isNotNull(), F.col(own["_form"]))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], form.alias(out))


def quotation_twins(assertion: DataFrame, block: DataFrame, doc: DataFrame) -> DataFrame:
    """(assertion_id, block_id): quotations of type 'present' and live blocks on the quoted page that look the same and are not the same string.

    Rows delivered twice count once; null texts, pages and documents have no twin. Texts are shuffled to find their classes only; rows
    carry hashes.
    """
    quoted = assertion.where("type = 'present'").select("assertion_id", "doc", "page", F.get_json_object("spec", "$.text").alias("text")).where("text IS NOT NULL")
    live = block.where("state = 0 AND text IS NOT NULL").select("block_id", "doc_ord", F.col("gen").alias("head"), "page", "text")
    mapped = quoted.select(by_look(F.col("text")).alias("m")).unionByName(live.select(by_look(F.col("text")).alias("m")))
    classes = canonical_classes(mapped).select("k1", "k2", F.xxhash64("canonical").alias("c1"), F.xxhash64(F.lit(1), "canonical").alias("c2"))

    def keyed(df: DataFrame, own: str) -> DataFrame:
        hashed = df.withColumn("ks", F.get(F.transform(F.array(by_look(F.col("text"))), lambda m: F.struct(*look_key(m))), 0))
        return hashed.select("*", "ks.k1", "ks.k2", F.xxhash64("text").alias(own)).drop("ks", "text")

    heads = doc.select("doc_ord", F.col("gen").alias("head"), F.col("uri").alias("doc"))
    a = keyed(quoted, "t_a").join(heads, "doc").drop("doc").join(classes, ["k1", "k2"]).drop("k1", "k2")
    b = keyed(live, "t_b").join(classes, ["k1", "k2"]).drop("k1", "k2")
    return a.join(b, ["doc_ord", "head", "page", "c1", "c2"]).where("t_a <> t_b").select("assertion_id", "block_id").distinct()
