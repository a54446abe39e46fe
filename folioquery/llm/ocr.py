"""Problem 5: noise in text from scanned pages.

The character stream of a block is de-lined and decoded over a word lattice. Its edges: a word as it stands; a word of the corpus of which it is a
confusion; two words run together; a word torn by a space; a word divided by a hyphen at a line end, joined or a compound
that keeps it; a number with letters for digits. The corpus's own vocabulary, counted over all blocks that were not scanned, gives words and
their costs. A confusion rewrites single characters only, so all spellings that can be taken for one another share a skeleton, a
per-character expansion; words meet the vocabulary by an equi-join on that, and an alignment counts the confusions.
Edges begin and end between words or inside words that do not stand as they are, over any number of words, with confusions. Of the edges
that span exactly one word the cheapest is kept for each distinct word; all others compete in the parts of a stream where a lower bound of their cost, from
a table of the vocabulary's skeletons, lets them be on the cheapest path. Everywhere else the path is forced.
Running lines and page numbers are found per document from the outer lines of its pages: an edge of a page holds at most one running line and one number. Paragraphs of the clean text are chosen by dynamic programming over its line ends.

Defined results: null, empty and blank texts have no noise; rows delivered twice count once; a block without a page or reading
position is judged by its words alone; texts in scripts without these confusions have none.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .lookalike import composed, look_table

SCANNED = ["ocr_page", "ocr_block"]
CLEAN = ["native", "native_xml", "text_layer", "user"]
#: A running line stands on at least so many pages.
RUNNING_PAGES = 3
HYPHENS = "-‐‑¬­"
JOINT = "­"

# What scanning takes characters for (true, seen).
CONFUSIONS = [
    ("e", "c"), ("i", "l"), ("i", "1"), ("l", "1"), ("l", "i"), ("s", "5"), ("o", "0"), ("g", "9"), ("h", "b"), ("b", "8"), ("b", "6"), ("z", "2"), ("t", "l"),
    ("é", "6"), ("é", "c"), ("d", "cl"), ("m", "rn"), ("u", "ii"), ("ü", "ii"), ("w", "vv"), ("li", "h"), ("cl", "d"), ("rn", "m"),
]
#: Per-character expansion under which every confusion leaves the skeleton as it is.
_EXPAND = {"u": "ii", "ü": "ii", "h": "ii", "b": "ii", "8": "ii", "6": "X", "d": "ci", "m": "rn", "w": "vv", "l": "i", "1": "i", "t": "i", "e": "c", "é": "c", "s": "5", "o": "0", "g": "9", "z": "2"}
_SKELETON = str.maketrans(_EXPAND)

_WORD = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIVISION = rf"[{HYPHENS}](?:[^\S\n]+|[^\S\n]*\n\s*)"
_DIVIDED = re.compile(rf"([^\W_]+){_DIVISION}(?=([^\W_]+))")
_OPEN_END = re.compile(rf"([^\W_]+)[{HYPHENS}]\s*$")
_ROMAN = re.compile(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_DASH = re.compile("[‐‑]")
_FIRST = re.compile(r"[^\W_]+")


def skeletons(word: str) -> list[str]:
    """Skeletons of a folded word; the seen character 6 may stand for é or b."""
    s = word.translate(_SKELETON)
    return [s] if "X" not in s else list({s.replace("X", "c"), s.replace("X", "ii")})


def confusions_between(true: str, seen: str) -> int | None:
    """The least number of confusions that turn `true` into `seen`, both folded; None if they cannot."""
    best = {(0, 0): 0}
    for i in range(len(true) + 1):
        for j in range(len(seen) + 1):
            at = best.get((i, j))
            if at is None:
                continue
            if i < len(true) and j < len(seen) and true[i] == seen[j]:
                best[i + 1, j + 1] = min(at, best.get((i + 1, j + 1), at))
            for t, s in CONFUSIONS:
                if true.startswith(t, i) and seen.startswith(s, j):
                    to = (i + len(t), j + len(s))
                    best[to] = min(at + 1, best.get(to, at + 1))
    return best.get((len(true), len(seen)))


@cache
def roman(n: int) -> str:
    out = ""
    for value, mark in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("m", "cm", "d", "cd", "c", "xc", "l", "xl", "x", "ix", "v", "iv", "i")):
        out += mark * (n // value)
        n %= value
    return out


_AS_DIGIT = str.maketrans("lIi|OoSsBbgqZz", "11110055869922"[:14])
_PAGE_WORDS = {"p", "page", "pag", "pág", "página", "s", "seite", "pg", "стр", "σελ"}
_TOTALS = {"/", "of", "de", "von", "sur", "di"}


@lru_cache(maxsize=200_000)
def own_number(token: str, number: int) -> bool | None:
    """Whether the token is the page's number: False exactly, True with confusions, None not."""
    if token == str(number) or token.casefold() == roman(number):
        return False
    if token.translate(_AS_DIGIT) == str(number):
        return True
    want = roman(number)
    folded = token.casefold()
    return True if len(want) > 1 and want.translate(_SKELETON) in skeletons(folded) and confusions_between(want, folded) is not None else None


_NUM = r"[0-9a-zA-Z|]+"
_NUMBER_PART = rf"[\[(\-–—\s]*(?:[^\W\d_]+\.?\s+)?({_NUM})(?:\s*(?:/|[^\W\d_]{{2,3}})\s*{_NUM})?[\])\-–—\s.]*"
_ONLY = re.compile(_NUMBER_PART)
_TAIL = re.compile(r"(.+?)(?:\s{2,}|\s*[|·]\s*|\s+(?=[\[(\-–—]))(" + _NUMBER_PART + ")")
_HEAD = re.compile("(" + _NUMBER_PART + r")(?:\s{2,}|\s*[|·]\s*|(?<=[\])\-–—])\s+)(.+)")


_TOKEN = re.compile(r"[0-9a-zA-Z|]+")


def _may_hold(line: str, number: int) -> bool:
    """Whether a word of a line can be the number: a cheap test before the patterns."""
    return any(own_number(t, number) is not None for t in _TOKEN.findall(line))


def line_info(line: str, page: int | None) -> tuple[bool, bool, bool, str | None, str | None]:
    """(pure, numbered, misread, key, plain) of an outer line: whether it is only, or holds, its page's number; of the rest as a running line the key, which
    misread characters do not change, and the letters as they are."""
    number, rest, pure, numbered, wrong = (page + 1 if page is not None else None), line, False, False, False
    if number is not None and _may_hold(line, number):
        m = _ONLY.fullmatch(line)
        if m and (hit := own_number(m[1], number)) is not None and _page_words(line, m):
            return True, True, hit or _misread_words(line) or any(number_read(t) is not None for t in _TOKEN.findall(line)), None, None
        for pattern, num, title in ((_TAIL, 2, 1), (_HEAD, 1, -1)):
            m = pattern.fullmatch(line)
            if m:
                n = _ONLY.fullmatch(m[num])
                if n and (hit := own_number(n[1], number)) is not None and _page_words(m[num], n):
                    rest, numbered, wrong = m[title] if title > 0 else m[m.lastindex], True, hit
                    break
    letters = _LETTERS.findall(rest)
    first = rest.lstrip("«„“\"'¿¡([ ")[:1]
    if len("".join(letters)) < 3 or rest[-1:] in ".!?:;,…»”’\"-‐¬­" or not (first.isupper() or first.isdigit() or first in "l|"):
        return False, numbered, wrong, None, None
    style = "U" if sum(c.isupper() for c in rest) * 2 > sum(map(len, letters)) else "l"
    folded = "".join(c for c in unicodedata.normalize("NFC", rest).casefold() if c.isalnum())
    return False, numbered, wrong, style + folded.translate(_SKELETON).replace("X", "c"), folded


def _page_words(text: str, m: re.Match) -> bool:
    """Whether all words beside the number belong to a page number's form."""
    before = _LETTERS.findall(text[: m.start(1)].casefold())
    between = [w for w in _LETTERS.findall(text[m.end(1) :].casefold())]
    near = lambda w, words: any(confusions_between(x, w) is not None for x in words if len(x) > 1) or w in words
    return all(near(w, _PAGE_WORDS) for w in before) and all(near(w, _TOTALS) or len(w) <= 2 for w in between[:1])


def _misread_words(text: str) -> bool:
    """Whether a word of a page number's form is misread."""
    words = [w for w in re.findall(r"[^\W_]{3,}", text.casefold()) if not w.isdigit()]
    return any(w not in _PAGE_WORDS and not _ROMAN.fullmatch(w) and any(confusions_between(x, w) for x in _PAGE_WORDS if len(x) > 2) for w in words)


_NUMBER_LIKE = re.compile(r"[0-9lIiOoSsBbgqZz|]{2,}")
_HEX = re.compile(r"[0-9a-f]{8,}")
_VERSION = re.compile(r"[^\W\d_]\d+")


def number_read(token: str) -> str | None:
    """The number that a token is when letters in it stand for digits: half of it at least are digits, and it is neither a letter before a number nor a
    hexadecimal code."""
    digits = sum(c.isdigit() for c in token)
    if not 0 < digits < len(token) or digits * 2 < len(token) or _HEX.fullmatch(token) or not _NUMBER_LIKE.fullmatch(token) or _VERSION.fullmatch(token) and token[0] not in "lIO|":
        return None
    return token.translate(_AS_DIGIT)


_PART = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)*|[^\w\s]+|_+")


def words_of(text: str) -> list[str]:
    """The words of a de-lined text in order, numbers apart; a divided word is one joint (left + JOINT + right); an empty string stands where more than
    white space, or a number, lies between two words."""

    def take(part: str) -> list[str]:
        found = _PART.findall(part)
        if "-" in part or "‐" in part or "‑" in part:
            found = [x for w in found for x in (re.split("([-‐‑])", w) if w[0].isalnum() and not w.isalnum() else (w,))]
        return [w if w[0].isalnum() and not w.isdigit() else "" for w in found]

    out, at = [], 0
    for m in _DIVIDED.finditer(text):
        out += [*take(text[at : m.start()]), f"{m[1]}{JOINT}{m[2]}"]
        at = m.end(2)
    rest = text[at:]
    if rest.rstrip()[-1:] and rest.rstrip()[-1:] in HYPHENS:
        rest = _OPEN_END.sub(" ", rest)
    out += take(rest)
    return out


_INFO = pa.struct([("line", pa.int32()), ("pure", pa.bool_()), ("numbered", pa.bool_()), ("wrong", pa.bool_()), ("key", pa.string()), ("plain", pa.string())])
_BLOCK = pa.schema(
    [("block_id", pa.int64()), ("doc_ord", pa.int64()), ("page", pa.int32()), ("ord", pa.int32()), ("n_lines", pa.int32()), ("heads", pa.list_(_INFO)), ("tails", pa.list_(_INFO)), ("firsts", pa.list_(pa.string())), ("ends", pa.list_(pa.string())), ("stream", pa.list_(pa.string()))]
)
_INFO_DDL = "array<struct<line:int,pure:boolean,numbered:boolean,wrong:boolean,key:string,plain:string>>"
_BLOCK_DDL = f"block_id bigint, doc_ord bigint, page int, ord int, n_lines int, heads {_INFO_DDL}, tails {_INFO_DDL}, firsts array<string>, ends array<string>, stream array<string>"


def read_block(text: str, page: int | None) -> dict:
    """What later steps need of a block's text; positions are kept for up to two outer lines that may turn out to be no body."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    infos = {i: line_info(lines[i], page) for i in {0, 1, len(lines) - 2, len(lines) - 1} if 0 <= i < len(lines)}
    info = lambda i: dict(zip(("line", "pure", "numbered", "wrong", "key", "plain"), (i, *infos[i])))
    first = [m[0] if i < len(lines) and (m := _FIRST.search(lines[i])) else None for i in range(3)]
    ends = [m[1] if len(lines) > i and (m := _OPEN_END.search(lines[len(lines) - 1 - i])) else None for i in range(3)]
    numbers = {i for i, x in infos.items() if x[0]}
    stream = words_of("\n".join(x for i, x in enumerate(lines) if i not in numbers))
    return {"n_lines": len(lines), "heads": [info(i) for i in (0, 1) if i < len(lines)], "tails": [info(i) for i in (len(lines) - 1, len(lines) - 2) if i >= 0], "firsts": first, "ends": ends, "stream": stream}


def scanned_blocks(block: DataFrame, doc: DataFrame) -> DataFrame:
    """The live scanned blocks with text."""
    heads = doc.select("doc_ord", "gen")
    return block.where(F.col("method").isin(SCANNED) & (F.col("state") == 0) & (F.length(F.trim("text")) > 0)).select("block_id", "doc_ord", "gen", "page", "ord", "text").join(heads, ["doc_ord", "gen"])


def read_blocks(scanned: DataFrame) -> DataFrame:
    """One row of parts per block, without its text; each block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs, pages, ords, texts = (c.to_pylist() for c in batch.columns)
            rows = [{"block_id": i, "doc_ord": d, "page": p, "ord": o, **read_block(t, p)} for i, d, p, o, t in zip(ids, docs, pages, ords, texts)]
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)

    return scanned.select("block_id", "doc_ord", "page", "ord", "text").mapInArrow(run, _BLOCK_DDL)


@cache
def _odd() -> re.Pattern:
    """Characters that the mapping by look may change; beyond the basic plane as ranges, since single ones there are tried one after another."""
    single, several = look_table()
    return re.compile("[" + re.escape("".join(c for c in [*single, *several] if ord(c) < 0x10000)) + "\U0001d400-\U0001d7ff\U000e0000-\U000e01ef]")


def vocabulary(block: DataFrame) -> DataFrame:
    """(word, n): folded words, and compounds, of all live blocks that were not scanned."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            folded: Counter[str] = Counter()
            for w, n in seen.items():
                word = _DASH.sub("-", w.casefold())
                folded[word] += n
                if "-" in word:
                    for part in word.split("-"):
                        folded[part] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(folded), pa.string()), pa.array(list(folded.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(_WORD.findall(text if text.isascii() else composed(text) if _odd().search(text) else unicodedata.normalize("NFC", text)))
            if len(seen) > 500_000:
                yield flush()
        if seen:
            yield flush()

    words = block.where(F.col("method").isin(CLEAN) & (F.col("state") == 0) & F.col("text").isNotNull()).select("text").mapInArrow(count, "word string, n bigint")
    return words.where(~F.col("word").rlike("^[0-9]*$")).groupBy("word").agg(F.sum("n").alias("n"))


def with_skeletons(vocab: DataFrame) -> DataFrame:
    """(word, n, skeleton) of the vocabulary."""

    def bones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([skeletons(w)[0] for w in words], pa.string())], names=["word", "n", "skeleton"])

    return vocab.mapInArrow(bones, "word string, n bigint, skeleton string")


#: A vocabulary word must occur so often to correct another.
LEAST_SUPPORT = 3


def resolve(tokens: DataFrame, known: DataFrame, vocab: DataFrame, total: int, longest: int) -> DataFrame:
    """(token, cost, fix, misread, hyphen, known) of distinct words and joints that do not stand as they are, or are joints: the cheapest edge that spans
    exactly the token, and whether it leads to a known word. Edges between the same two places differ by their cost alone, so the others are on no
    cheapest path. known is the vocabulary with skeletons; total and longest measure it."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for token in batch.column(0).to_pylist():
                folded = unicodedata.normalize("NFC", token).casefold()
                forms = [(folded, None)] if JOINT not in token else [(folded.replace(JOINT, ""), True), (folded.replace(JOINT, "-"), False)]
                for form, joined in forms:
                    out += [(token, form, joined, s) for s in skeletons(form)]
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.string())], names=["token", "form", "joined", "skeleton"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, words = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            cost = [0 if f == w else None if w is None else confusions_between(w, f) for f, w in zip(forms, words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cost, pa.int32())], names=[*batch.schema.names, "cost"])

    spelled = tokens.mapInArrow(spell, "token string, form string, joined boolean, skeleton string")
    meets = spelled.join(known, "skeleton", "left").select("token", "form", "joined", "word", "n")
    costed = meets.mapInArrow(align, "token string, form string, joined boolean, word string, n bigint, cost int")
    fair = F.col("cost").isNotNull() & ((F.col("cost") == 0) | (F.col("n") >= LEAST_SUPPORT))
    read = costed.groupBy("token").agg(F.collect_set(F.when(fair, F.struct("word", "n", "cost", "joined"))).alias("readings"))
    unknown = read.where(~F.exists("readings", lambda r: r["joined"].isNull() & (r["cost"] == 0))).select("token")
    return read.join(splits(unknown, vocab, total, longest), "token", "left").mapInArrow(lambda b: _settle(b, total), _EDGE)


# Costs of the lattice's edges beside the costs of their words, log(all words / occurrences).
CONFUSION, JOINED, SPACE, UNKNOWN, SETTLED = 8.0, 2.0, 5.0, 6.0, 7.0
_EDGE = "token string, cost double, fix string, misread boolean, hyphen boolean, known boolean"
_PLAIN_JOINT = re.compile(rf"[^\W_]*[^\W\d_]{JOINT}(?=[^\W_]*[^\W\d_])[^\W_A-ZÀ-ÖØ-Þ]+")


def price(n: int, total: int) -> float:
    return math.log(max(total, 1) / max(n, 1))


def splits(tokens: DataFrame, vocab: DataFrame, total: int, longest: int) -> DataFrame:
    """(token, split, split_n): tokens that are two words run together, with the likeliest two and the product of their counts.

    That holds only where the two words, by their counts, are expected next to each other more than once while the whole never occurs;
    so names and compounds made of rarer words stay whole. A part longer than the vocabulary's longest word is none of it.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for token in batch.column(0).to_pylist():
                if token.isalpha():
                    low = unicodedata.normalize("NFC", token).casefold()
                    out += [(token, low[:i], low[i:]) for i in range(max(1, len(low) - longest), min(len(low) - 1, longest) + 1)]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["token", "left", "right"])

    left, right = (vocab.select(F.col("word").alias(c), F.col("n").cast("double").alias(f"n_{c}")) for c in ("left", "right"))
    # A word that may be one of a likely pair occurs often enough for the most frequent word as the other.
    both = tokens.mapInArrow(parts, "token string, left string, right string").join(left, "left").join(right, "right")
    likely = both.where(F.col("n_left") * F.col("n_right") > math.e * total)
    return likely.groupBy("token").agg(F.max(F.struct((F.col("n_left") * F.col("n_right")).alias("n"), F.concat_ws(" ", "left", "right").alias("s"))).alias("x")).select("token", F.col("x.s").alias("split"), F.col("x.n").alias("split_n"))


def token_edges(token: str, readings: list[dict], split: str | None, split_n: float | None, total: int) -> list[tuple[float, str | None, bool, bool, bool]]:
    """(cost, fix, misread, hyphen, known) of all edges of the lattice that span one token that is not settled."""
    joint = JOINT in token
    out = [(price(1, total) + UNKNOWN + CONFUSION * len(token), None, False, joint and bool(_PLAIN_JOINT.fullmatch(token)), False)]
    for r in readings:
        out.append((price(r["n"], total) + CONFUSION * r["cost"] + (JOINED if r["joined"] else 0.0), r["word"], r["cost"] > 0, bool(r["joined"]), True))
    exact = any(r["cost"] == 0 for r in readings)
    if not joint and not exact and (number := number_read(token)) is not None:
        out.append((SETTLED + CONFUSION, number, True, False, True))
    if split:
        out.append((2 * price(1, total) - math.log(split_n) + SPACE, split, False, False, True))
    return out


def _settle(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = []
        for t, r, s, n in zip(*(c.to_pylist() for c in batch.columns)):
            cost, fix, misread, hyphen, known = min(token_edges(t, r, s, n, total), key=lambda e: (e[0], str(e[1])))
            if JOINT in t or not known or misread or fix != unicodedata.normalize("NFC", t).casefold():
                best.append((t, cost, fix, misread, hyphen, known))
        cols = list(zip(*best)) if best else [[]] * 6
        kinds = (pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["token", "cost", "fix", "misread", "hyphen", "known"])


#: Bits of the table of skeletons. Skeletons that share a place cost a look-up in the vocabulary, nothing else.
_PLACES = 24
_BEGUN, _WORD_LEVEL = 1, 2


@cache
def _skeleton_bytes(c: str) -> tuple[bytes, ...]:
    return tuple(s.encode("utf-8", "surrogatepass") for s in skeletons(c))


def skeleton_table(known: DataFrame) -> bytes:
    """One byte for each place of a skeleton's check sum: 0 where no word of enough support has or begins with it, 1 where one begins with it, from 2 on
    four times the logarithm of the count of the most frequent word that has it, rounded up."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level: dict[int, int] = {}
            for n, skeleton in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                for c in skeleton:
                    at = zlib.crc32(c.encode("utf-8", "surrogatepass"), at)
                    level.setdefault(at & ((1 << _PLACES) - 1), _BEGUN)
                place = at & ((1 << _PLACES) - 1)
                level[place] = max(level.get(place, 0), min(255, _WORD_LEVEL + math.ceil(4 * math.log(n))))
            yield pa.RecordBatch.from_arrays([pa.array(list(level), pa.int32()), pa.array(list(level.values()), pa.int32())], names=["place", "level"])

    rows = known.where(F.col("n") >= LEAST_SUPPORT).select("n", "skeleton").mapInArrow(marks, "place int, level int").groupBy("place").agg(F.max("level").alias("level")).toArrow()
    table = np.zeros(1 << _PLACES, np.uint8)
    table[rows.column("place").to_numpy()] = rows.column("level").to_numpy()
    return table.tobytes()


class Lexicon:
    """What of the vocabulary every task holds: the table of skeletons, by which most spans of a stream are seen to be no word."""

    def __init__(self, table: bytes, total: int):
        self.table, self.total = table, total
        self.after = lru_cache(maxsize=500_000)(self._after)

    def step(self, states: tuple[int, ...], c: str) -> tuple[int, ...]:
        """The check sums after one more character that still begin a word."""
        at = [zlib.crc32(b, s) for s in states for b in _skeleton_bytes(c)]
        return tuple(s for s in at if self.table[s & ((1 << _PLACES) - 1)])

    def _after(self, *words: str) -> tuple[int, ...]:
        states: tuple[int, ...] = (0,)
        for c in "".join(map(letters_of, words)):
            states = self.step(states, c)
        return states

    def least(self, states: tuple[int, ...]) -> float | None:
        """A lower bound of the price of the words that a span can be; None if it is none."""
        level = max((self.table[s & ((1 << _PLACES) - 1)] for s in states), default=0)
        return None if level < _WORD_LEVEL else max(0.0, math.log(max(self.total, 1)) - (level - _WORD_LEVEL) / 4)


@lru_cache(maxsize=200_000)
def letters_of(token: str) -> str:
    """The folded letters of a word or joint."""
    return unicodedata.normalize("NFC", token.replace(JOINT, "")).casefold()


def may_be_cut(token: str) -> bool:
    return JOINT not in token and token.isalpha()


def spans_of(run: list[str], opened: dict[str, float], lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """(start, end, least price) of the spans of a run's letters, other than single words, that can be a word of the vocabulary. A span begins and ends
    between words or inside a word that does not stand as it is."""
    out: list[tuple[int, int, float]] = []
    text, ends, base = None, set(), 0
    for i, word in enumerate(run):
        size = len(letters_of(word))
        cuts = word in opened and may_be_cut(word)
        if cuts or i + 1 < len(run) and (lexicon.after(word, run[i + 1]) if run[i + 1] not in opened else lexicon.after(word)):
            if text is None:
                text, at = "".join(map(letters_of, run)), 0
                for w in run:
                    ends.update(range(at + 1, at + len(letters_of(w)) + 1) if w in opened and may_be_cut(w) else [at + len(letters_of(w))])
                    at += len(letters_of(w))
            for start in range(base, base + size) if cuts else (base,):
                states: tuple[int, ...] = (0,)
                for at in range(start, len(text)):
                    states = lexicon.step(states, text[at])
                    if not states:
                        break
                    if at + 1 in ends and (start, at + 1) != (base, base + size) and (least := lexicon.least(states)) is not None:
                        out.append((start, at + 1, least))
        base += size
    return out


def open_regions(run: list[str], opened: dict[str, float], lexicon: Lexicon) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(first word, word after the last, spans) of the parts of a run where edges that do not span single words may be on the cheapest path; the places of
    spans count from the part's first letter. Everywhere else the path is forced."""
    spans = spans_of(run, opened, lexicon)
    if not spans:
        return
    bounds = [0]
    for w in run:
        bounds.append(bounds[-1] + len(letters_of(w)))
    index = {b: i for i, b in enumerate(bounds)}
    from_, rare = {}, price(1, lexicon.total)
    for s in spans:
        from_.setdefault(s[0], []).append(s)
    found: list[tuple[int, int, set[tuple[int, int]]]] = []
    for i, first in enumerate(bounds[:-1]):
        if first not in from_:
            continue
        # The least cost of reaching a place by spans that meet inside words, and the spans that lead there.
        reach: dict[int, tuple[float, set[tuple[int, int]]]] = {first: (0.0, set())}
        for at in sorted({s[0] for s in spans if s[0] >= first}):
            if at not in reach or at != first and at in index:
                continue
            cost, through = reach[at]
            for _, end, least in from_[at]:
                more = cost + least + (SPACE if end not in index else 0.0)
                old = reach.get(end, (math.inf, set()))
                reach[end] = (min(old[0], more), old[1] | through | {(at, end)})
        for end, (cost, through) in reach.items():
            if end in index and through:
                j = index[end]
                if cost + SPACE * (j - i - 1) < sum(opened.get(w, rare) for w in run[i:j]):
                    found.append((i, j, through))
    merged: list[tuple[int, int, set[tuple[int, int]]]] = []
    for i, j, through in sorted(found, key=lambda x: x[:2]):
        if merged and i < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(j, merged[-1][1]), merged[-1][2] | through)
        else:
            merged.append((i, j, through))
    for i, j, through in merged:
        yield i, j, sorted((a - bounds[i], b - bounds[i]) for a, b in through)


def may_begin(word: str, after: str, opened: dict[str, float], lexicon: Lexicon) -> bool:
    """Whether a part that is not forced may begin with a word before another (empty: none): the word itself may be several, or a span goes on into the
    next one. A part over several words has a span across the end of its first."""
    cuts = word in opened and may_be_cut(word)
    if cuts and next(open_regions([word], opened, lexicon), None):
        return True
    if not after:
        return False
    letters, needed = letters_of(word), letters_of(after)
    if after in opened and may_be_cut(after):
        needed = needed[0]
    for start in range(len(letters)) if cuts else (0,):
        states: tuple[int, ...] = lexicon.after(word) if not start else (0,)
        for c in letters[start:] + needed if start else needed if states else "":
            states = lexicon.step(states, c)
            if not states:
                break
        if states:
            return True
    return False


_near = lru_cache(maxsize=200_000)(confusions_between)


def cheapest_path(words: list[str], single: list[tuple[float, str | None, bool, bool] | None], met: list[tuple[int, int, str, int]], total: int) -> list[tuple[str, str | None, bool, bool]]:
    """(token, fix, misread, hyphen) of the edges of the cheapest path through neighbouring words that change something; the token of an edge over several
    words has spaces between them.

    single: (cost, fix, misread, hyphen) of the cheapest edge that spans a word, None where it stands as it is; met: (start, end, word, n) of spans of
    the letters and the words of the vocabulary with their skeleton. Where words are divided otherwise than they stand, the new ones must be likelier
    than the old ones, a word that nothing knows taken as one that is expected once; so names and compounds of rarer words stay whole.
    """
    bounds = [0]
    for w in words:
        bounds.append(bounds[-1] + len(letters_of(w)))
    text, index = "".join(map(letters_of, words)), {b: i for i, b in enumerate(bounds)}
    stands = {(s, w): n for s, e, w, n in met if text[s:e] == w}
    own = [price(stands.get((bounds[i], letters_of(w)), 1), total) if single[i] is None else price(1, total) - 1 for i, w in enumerate(words)]
    from_: dict[int, list[tuple[int, str, float, int]]] = {}
    for s, e, w, n in met:
        wrong = _near(w, text[s:e])
        if wrong is not None and n >= LEAST_SUPPORT and not (s in index and index.get(e) == index[s] + 1):
            from_.setdefault(s, []).append((e, w, price(n, total) + CONFUSION * wrong, wrong))
    best: list[tuple[float, list]] = [(0.0, [])] + [(math.inf, [])] * len(words)
    for i, first in enumerate(bounds[:-1]):
        cost, path = best[i]
        step = (cost + (own[i] if single[i] is None else single[i][0]), path if single[i] is None else [*path, (words[i], *single[i][1:])])
        best[i + 1] = min(best[i + 1], step, key=lambda e: e[0])
        # (place, number of words) -> (cost, words, confusions): the new words from here that meet inside old ones.
        reach: dict[tuple[int, int], tuple[float, list[str], int]] = {(first, 0): (0.0, [], 0)}
        for at in [first, *(x for x in sorted(from_) if x > first and x not in index)]:
            for parts in range(at - first + 1):
                if (at, parts) in reach:
                    so_far, taken, wrong = reach[at, parts]
                    for end, w, more, c in from_.get(at, ()):
                        if so_far + more < reach.get((end, parts + 1), (math.inf,))[0]:
                            reach[end, parts + 1] = (so_far + more, [*taken, w], wrong + c)
        for (end, parts), (new, taken, wrong) in reach.items():
            if parts and end in index:
                j = index[end]
                moved = SPACE * (j - i - 1 + parts - 1)
                # Several words for several must be likelier with the moved spaces too: short words fit into any letters.
                if new + (moved if parts > 1 and j - i > 1 else 0.0) >= sum(own[i:j]):
                    continue
                joints = sum(JOINT in w for w in words[i:j])
                whole = cost + new + moved + JOINED * joints
                best[j] = min(best[j], (whole, [*path, (" ".join(words[i:j]), " ".join(taken), wrong > 0, joints > 0)]), key=lambda e: e[0])
    return [e for e in best[-1][1] if e[1] is not None or e[2] or e[3]]


def open_windows(stream: list[str], opened: set[str]) -> Iterator[list[str]]:
    """The runs of words of a stream that do not stand as they are, with a neighbour that does on either side."""
    at = 0
    while at < len(stream):
        if stream[at] not in opened:
            at += 1
            continue
        end = at
        while end < len(stream) and stream[end] in opened:
            end += 1
        window = stream[at - 1 if at and stream[at - 1] else at : end + 1 if end < len(stream) and stream[end] else end]
        if len(window) > 1:
            yield window
        at = end


def merged_words(window: list[str], costs: dict[str, float], words: dict[str, int], total: int) -> list[str]:
    """The pairs "left right" of a window that the cheapest path merges into one word. costs has the cheapest single edge of each word that does not
    stand as it is, words the counts of the vocabulary."""
    single = [(costs[w], None, False, False) if w in costs else None for w in window]
    met, at = [], 0
    for i, w in enumerate(window):
        for form in (letters_of(w), "".join(map(letters_of, window[i : i + 2]))):
            met += [(at, at + len(form), form, words[form])] if form in words else []
        at += len(letters_of(w))
    return [e[0] for e in cheapest_path(window, single, met, total) if " " in e[0]]


def runs_of(stream: list[str]) -> Iterator[list[str]]:
    """The parts of a stream without anything but white space between their words."""
    run: list[str] = []
    for w in stream:
        if w:
            run.append(w)
        elif run:
            yield run
            run = []
    if run:
        yield run


_PATH = "array<struct<token:string,fix:string,misread:boolean,hyphen:boolean>>"
_SINGLE = pa.struct([("token", pa.string()), ("cost", pa.float64()), ("fix", pa.string()), ("misread", pa.bool_()), ("hyphen", pa.bool_())])


def lattice(streams: DataFrame, edges: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """(block_id, only, path): the parts of streams where the cheapest path is not that of each word's own cheapest edge for want of others: the edges of
    their cheapest paths, and the words of the block that stand in such parts alone."""
    spark = streams.sparkSession
    table = spark.sparkContext.broadcast(skeleton_table(known))
    opened = edges.groupBy("block_id").agg(F.collect_list(F.struct("token", "cost", "fix", "misread", "hyphen")).alias("opened"))
    region = pa.schema([("block_id", pa.int64()), ("seq", pa.int32()), ("only", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("single", pa.list_(_SINGLE)), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("skeleton", pa.string())])))])
    ddl = "block_id bigint, seq int, only array<string>, words array<string>, single array<struct<token:string,cost:double,fix:string,misread:boolean,hyphen:boolean>>, spans array<struct<start:int,end:int,skeleton:string>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(table.value, total)
        begins: dict[tuple[str, str], bool] = {}
        for batch in batches:
            # What spans a single word is the same in every block, so each pair of neighbours is looked at once.
            edges_ = batch.column(2).flatten()
            first = np.unique(edges_.field("token").dictionary_encode().indices.to_numpy(zero_copy_only=False), return_index=True)[1]
            single = {e["token"]: e for e in edges_.take(pa.array(first)).to_pylist()}
            costs = {t: e["cost"] for t, e in single.items()}
            flat = batch.column(1).flatten().dictionary_encode()
            words_, codes = [*flat.dictionary.to_pylist(), ""], flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            after = np.append(codes[1:], len(words_) - 1)[: len(codes)]
            after[ends[ends > 0] - 1] = len(words_) - 1
            pairs, where = np.unique(codes * len(words_) + after, return_inverse=True)
            if len(begins) > 1_000_000:
                begins.clear()
            hit = []
            for pair in pairs.tolist():
                key = (words_[pair // len(words_)], words_[pair % len(words_)])
                if key not in begins:
                    begins[key] = bool(key[0]) and may_begin(*key, costs, lexicon)
                hit.append(begins[key])
            rows = []
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(np.array(hit, bool)[where]), side="right")).tolist():
                here, plain = [], set()
                for run in runs_of(batch.column(1)[i].as_py()):
                    at = 0
                    held = any(begins[pair] for pair in zip(run, [*run[1:], ""]))
                    for j, k, spans in open_regions(run, costs, lexicon) if held else ():
                        words = run[j:k]
                        text, start = "".join(map(letters_of, words)), 0
                        for w in words:
                            if w not in costs:
                                spans.append((start, start + len(letters_of(w))))
                            start += len(letters_of(w))
                        here.append({"block_id": batch.column(0)[i].as_py(), "seq": len(here), "words": words, "single": [single.get(w) for w in words], "spans": [{"start": s, "end": e, "skeleton": x} for s, e in spans for x in skeletons(text[s:e])]})
                        plain.update(run[at:j])
                        at = k
                    plain.update(run[at:])
                rows += [r | {"only": [w for w in dict.fromkeys(r["words"]) if w not in plain and w in costs]} for r in here]
            yield pa.RecordBatch.from_pylist(rows, schema=region)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                single = [s and (s["cost"], s["fix"], s["misread"], s["hyphen"]) for s in r["single"]]
                path = cheapest_path(r["words"], single, [(m["start"], m["end"], m["word"], m["n"]) for m in r["met"] or []], total)
                rows.append({"block_id": r["block_id"], "only": r["only"], "path": [dict(zip(("token", "fix", "misread", "hyphen"), e)) for e in path]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block_id", pa.int64()), ("only", pa.list_(pa.string())), ("path", pa.list_(pa.struct([("token", pa.string()), ("fix", pa.string()), ("misread", pa.bool_()), ("hyphen", pa.bool_())])))]))

    regions = store(streams.join(opened, "block_id", "left").select("block_id", "stream", "opened").mapInArrow(find, ddl))
    met = regions.select("block_id", "seq", F.inline("spans")).join(known, "skeleton").groupBy("block_id", "seq").agg(F.collect_set(F.struct("start", "end", "word", "n")).alias("met"))
    return regions.drop("spans").join(met, ["block_id", "seq"], "left").mapInArrow(walk, f"block_id bigint, only array<string>, path {_PATH}")


def outer_lines(parts: DataFrame) -> DataFrame:
    """(block_id, line, header, page_number, wrong, other): the outer lines of pages that are running lines or hold the page's number; wrong: the number is
    misread; other: the running line is not spelled as on most pages."""
    place = parts.where("page IS NOT NULL AND ord IS NOT NULL").select("block_id", "doc_ord", "page", "ord", "heads", "tails")
    top = Window.partitionBy("doc_ord", "page").orderBy("ord", "block_id", "line")
    low = Window.partitionBy("doc_ord", "page").orderBy(F.desc("ord"), F.desc("block_id"), F.desc("line"))
    sides = []
    for side, column, window in (("top", "heads", top), ("bottom", "tails", low)):
        lines = place.select("block_id", "doc_ord", "page", "ord", F.inline(column))
        sides.append(lines.withColumn("at", F.row_number().over(window)).where("at <= 2").withColumn("side", F.lit(side)))
    both = sides[0].unionByName(sides[1])
    outer = both.withColumn("outer", F.first("pure").over(Window.partitionBy("doc_ord", "page", "side").orderBy("at")))
    edge = outer.withColumn("candidate", F.col("key").isNotNull() & ((F.col("at") == 1) | F.col("outer")))
    spelled = edge.where("candidate").groupBy("doc_ord", "key", "plain").agg(F.collect_set("page").alias("on"), F.count("*").alias("n"))
    pages = spelled.groupBy("doc_ord", "key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("on")))).alias("pages"), F.max(F.struct("n", "plain")).alias("usual")).where(F.col("pages") >= RUNNING_PAGES)
    marked = edge.join(pages, ["doc_ord", "key"], "left").withColumn("header", F.col("candidate") & F.col("pages").isNotNull())
    marked = marked.withColumn("outer_header", F.first("header").over(Window.partitionBy("doc_ord", "page", "side").orderBy("at")))
    number = F.col("numbered") & F.when(F.col("pure"), (F.col("at") == 1) | F.col("outer_header")).otherwise(F.col("header"))
    # A running line may be spelled otherwise than on most pages, though it has their key.
    other = F.col("header") & (F.col("usual.n") > 1) & (F.col("plain") != F.col("usual.plain"))
    out = marked.select("block_id", "line", "header", number.alias("page_number"), (number & F.col("wrong")).alias("wrong"), other.alias("other")).where("header OR page_number")
    return out.groupBy("block_id", "line").agg(F.bool_or("header").alias("header"), F.bool_or("page_number").alias("page_number"), F.bool_or("wrong").alias("wrong"), F.bool_or("other").alias("other"))


def decode(block: DataFrame, doc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, outer, body, readings): (block_id, token, cost, fix, misread, hyphen, known) of words that are not settled; the outer lines; (block_id, end, right, given) of blocks with body text in
    reading order, `end` a word begun at its end, `right` the first word of the next body, `given` whether its own first word
    completes the block before; (block_id, token, fix, misread, hyphen) of the words that are not to stand as they are."""
    parts = store(read_blocks(scanned_blocks(block, doc)).dropDuplicates(["block_id"]))
    outer = store(outer_lines(parts))
    per_block = outer.groupBy("block_id").agg(F.collect_set("line").alias("lines"))
    body = parts.select("block_id", "doc_ord", "page", "ord", "n_lines", "firsts", "ends").join(per_block, "block_id", "left")
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    skipped = lambda first, second: F.when(F.array_contains(lines, first), F.when(F.array_contains(lines, second), 2).otherwise(1)).otherwise(0)
    last = F.col("n_lines") - 1
    body = body.where(F.size(lines) < F.col("n_lines")).select("block_id", "doc_ord", "page", "ord", F.get("firsts", skipped(F.lit(0), F.lit(1))).alias("first"), F.get("ends", skipped(last, last - 1)).alias("end"))
    order = Window.partitionBy("doc_ord").orderBy("page", "ord", "block_id")
    body = body.withColumns({"right": F.lead("first").over(order), "given": F.lag("end").over(order).isNotNull()}).select("block_id", "doc_ord", "page", "ord", "end", "right", "given")
    crossing = body.where("end IS NOT NULL AND right IS NOT NULL").select("block_id", F.concat("end", F.lit(JOINT), "right").alias("token"))
    tokens = parts.select("block_id", F.explode(F.array_distinct("stream")).alias("token")).where("token <> ''").unionByName(crossing)
    vocab = store(with_skeletons(vocabulary(block)))
    size = vocab.agg(F.sum("n").alias("n"), F.max(F.char_length("word")).alias("longest")).first()
    total, longest = int(size["n"] or 0), int(size["longest"] or 0)
    edges = store(tokens.join(resolve(tokens.select("token").distinct(), vocab, vocab.select("word", "n"), total, longest), "token"))
    single = edges.where("misread OR hyphen OR fix IS NOT NULL").select("block_id", "token", "fix", "misread", "hyphen")
    joint = store(lattice(parts.select("block_id", "stream"), edges, vocab, total))
    # A word that stands only where several words are decoded together is read there alone.
    taken = joint.select("block_id", F.explode("only").alias("token")).distinct()
    together = joint.select("block_id", F.inline("path"))
    readings = single.join(taken, ["block_id", "token"], "left_anti").unionByName(together).distinct()
    return edges, outer, body, readings


def noise(block: DataFrame, doc: DataFrame) -> DataFrame:
    """(block_id, noise): one row for each kind of noise of each live scanned block."""
    edges, outer, body, readings = decode(block, doc)
    # An unusual spelling of a running line is a misread one if it holds a word that nothing knows.
    unknown = edges.where(~F.col("known") & ~F.contains("token", F.lit(JOINT))).select("block_id")
    named = lambda *pairs: F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(name)) for c, name in pairs]))).alias("noise")
    found = [
        readings.select("block_id", named(("misread", "misread"), ("hyphen", "hyphen"))),
        body.where("end IS NOT NULL AND right IS NULL").select("block_id", F.lit("hyphen").alias("noise")),
        outer.where("other").join(unknown, "block_id", "left_semi").select("block_id", F.lit("misread").alias("noise")),
        outer.select("block_id", named(("header", "header"), ("page_number", "page_number"), ("wrong", "misread"))),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _like(word: str, seen: str) -> str:
    """The word in the letter case of what was seen."""
    letters = [c for c in seen if c.isalpha()]
    if sum(c.isupper() for c in letters) > 1 and not any(c.islower() for c in letters[1:] if c not in "l"):
        return word.upper()
    return word[:1].upper() + word[1:] if seen[:1].isupper() or seen[:1] == "8" else word


def paragraph_breaks(lines: list[str]) -> list[int]:
    """The lines (after the first) that begin a paragraph, by dynamic programming over the line ends.

    A break costs less after a line that ends a sentence, more so if that line is short, and before a line that does not begin in lower
    case; a paragraph of one short line costs extra.
    """
    if not lines:
        return []
    width = max(map(len, lines))

    def gap(i: int) -> tuple[float, float]:
        before, after = lines[i - 1], lines[i]
        ended = before.rstrip("\"'”’»)")[-1:] in ".!?:…"
        short = len(before) < 0.75 * width
        lower = after[:1].islower()
        return (0.5 if ended and short else 1.6 if ended else 3.0) + (2.0 if lower else 0.0), 1.2 if ended and short and not lower else 0.2

    # One forward pass: the cost of going on is a running sum, so the best earlier start of a paragraph of several lines is kept as one value.
    best: list[tuple[float, int]] = [(0.0, 0)]
    total, several = 0.0, (math.inf, 0)
    for end in range(1, len(lines) + 1):
        start = end - 1
        begun = best[start][0] + (gap(start)[0] if start else 0.0)
        options = [(begun + (0.4 if len(lines[start]) < 0.5 * width else 0.0), start)]
        if start:
            total += gap(start)[1]
            options.append((several[0] + total, several[1]))
        best.append(min(options))
        several = min(several, (begun - total, start))
    out, at = [], len(lines)
    while at:
        at = best[at][1]
        if at:
            out.append(at)
    return out[::-1]


def repair(text: str, dropped: set[int], fixes: dict[str, tuple[str | None, bool, bool]], right: str | None, given: bool) -> list[str]:
    """The paragraphs of a block: outer lines gone, divided words joined, misread words put right.

    right: the rest of a word begun at its end, if that word is joined; given: its first word completes the block before.
    """
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    lines = [x for i, x in enumerate(lines) if i not in dropped]
    breaks = {0, *paragraph_breaks(lines)}
    stream = ""
    for i, line in enumerate(lines):
        stream += ("" if not i else "\n\n" if i in breaks and not re.search(rf"[^\W_][{HYPHENS}]$", stream) else "\n") + line
    if given:
        stream = _FIRST.sub("", stream, count=1).lstrip()

    def join(m: re.Match) -> str:
        fix = fixes.get(f"{m[1]}{JOINT}{m[2]}")
        keeps = not fix[2] if fix is not None else m[2][:1].islower() or m[2][:1].isdigit()
        return m[1] + ("-\x00" if keeps else "\x00")

    def word(m: re.Match) -> str:
        fix = fixes.get(m[0])
        return _like(fix[0], m[0]) if fix and fix[1] and fix[0] and JOINT not in m[0] else m[0]

    for token, (fix, _, _) in sorted(fixes.items(), key=lambda x: -len(x[0])):
        if " " in token and fix:
            several = r"\s+".join(re.escape(t).replace(re.escape(JOINT), _DIVISION) for t in token.split(" "))
            stream = re.sub(rf"(?<!\w){several}(?!\w)", lambda m, fix=fix: _like(fix, m[0]), stream)
    joined = re.sub(r"\x00", "", _DIVIDED.sub(join, stream))
    for token, (fix, misread, hyphen) in fixes.items():
        if " " not in token and JOINT in token and misread and fix:
            left, _, rest = token.partition(JOINT)
            joined = joined.replace(left + ("" if hyphen else "-") + rest, _like(fix, left + rest))
    end = _OPEN_END.search(joined)
    if end and right:
        fix = fixes.get(f"{end[1]}{JOINT}{right}")
        whole = _like(fix[0], end[1]) if fix and fix[0] and fix[1] else end[1] + ("" if fix is None or fix[2] else "-") + right
        joined = joined[: end.start()] + whole
    return [" ".join(p.split()) for p in _FIRST.sub(word, joined).split("\n\n") if p.strip()]


def paragraphs(block: DataFrame, doc: DataFrame) -> DataFrame:
    """(doc_ord, first_block, first_page, last_page, text): the scanned documents as continuous paragraphs in reading order.

    A block that ends inside a sentence goes on in the next block with body text.
    """
    _, outer, body, readings = decode(block, doc)
    drop = outer.groupBy("block_id").agg(F.collect_set("line").alias("lines"))
    fixes = readings.groupBy("block_id").agg(F.collect_set(F.struct("token", "fix", "misread", "hyphen")).alias("fixes"))
    texts = scanned_blocks(block, doc).select("block_id", "text").dropDuplicates(["block_id"])
    rows = texts.join(body, "block_id").join(drop, "block_id", "left").join(fixes, "block_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = {f["token"]: (f["fix"], f["misread"], f["hyphen"]) for f in r["fixes"] or []}
                for i, p in enumerate(repair(r["text"], set(r["lines"] or []), own, r["right"], r["given"])):
                    out.append({"doc_ord": r["doc_ord"], "page": r["page"], "ord": r["ord"], "block_id": r["block_id"], "part": i, "text": p, "open": p.rstrip("\"'”’»)")[-1:] not in ".!?:…", "lower": p.lstrip("«“„\"'(")[:1].islower()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_ord", pa.int64()), ("page", pa.int32()), ("ord", pa.int32()), ("block_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("open", pa.bool_()), ("lower", pa.bool_())]))

    parts = rows.select("doc_ord", "page", "ord", "block_id", "text", "right", "given", "lines", "fixes").mapInArrow(run, "doc_ord bigint, page int, ord int, block_id bigint, part int, text string, open boolean, lower boolean")
    order = Window.partitionBy("doc_ord").orderBy("page", "ord", "block_id", "part")
    starts = parts.withColumn("starts", ~F.coalesce(F.lag("open").over(order) & F.col("lower"), F.lit(False)))
    numbered = starts.withColumn("paragraph", F.sum(F.col("starts").cast("int")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("page", "ord", "block_id", "part", "text")))
    whole = numbered.groupBy("doc_ord", "paragraph").agg(pieces.alias("p"))
    return whole.select("doc_ord", F.get("p", 0)["block_id"].alias("first_block"), F.get("p", 0)["page"].alias("first_page"), F.element_at("p", -1)["page"].alias("last_page"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))
