"""Problem 8: sentence boundaries across languages and scripts.

A text falls into blocks between blank lines; a list item, heading, code line or table row is one unit. In spaced scripts the terminators of
a block are the nodes of a lattice whose edges are sentences: costs for breaking and for going on at each node (abbreviations, numbers,
initials, ordinals, reporting clauses after a quotation, letter case) and for unbalanced brackets on each edge; the cheapest path
is taken. In scripts without spaces the characters around a gap are segmented by a dictionary word lattice, and the gap is
classified by the word before it (final particles) and after it (opening words, particles that go on).

Defined results: null, empty and blank texts have no sentence; end positions count Unicode characters from the start of the text and
leave out white space after the sentence; what follows a sentence without a letter or digit of its own belongs to it.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER_DIR, read_ranks, texts_of

# Abbreviations by what follows them. They are compared in lower case, without the last full stop.
#: A name or a word always follows.
TITLES = set("dr prof mr mrs ms mx insp sr sra dra srta st hr fr mme mlle me gen col capt lt rev hon ing lic fig nº проф д-р г-н г-жа акад ул им κ κα δρ καθ डॉ श्री د".split())
#: The sentence goes on.
INNER = set("e.g i.e cf vs viz approx n.b z.b z u.a d.h d p.ex p.ej ex ej bzw vgl ca bspw sog evtl ggf inkl env aprox c.-à-d см ср т.е напр π.χ π βλ δηλ".split())
#: A number follows.
NUMBERED = set("no nos nr núm nums pág págs p pp s art arts sec secs fig figs eq vol vols ch chap para paras abs abb bd kap ziff tab anm n стр рис гл т п ст табл σελ αρ εικ κεφ ص ج पृ सं".split())
#: May end a sentence: the next word tells.
EITHER = set("etc ltd inc co corp jr sr. a.m p.m am pm usw u.s.w al д п пр др κ.λπ κλπ κ.ά вв гг руб".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
BEFORE_ORDINAL = set("am im vom zum beim bis ab seit der die das dem den des ein eine einem einen einer und".split())
REPORTED = r"(?:asked|demanded|inquired|wondered|cried|exclaimed|shouted|said)"
# Closed classes of the spaceless scripts. The lattices add the words of a public vocabulary to them.
#: Particles and conjunctions with which a sentence goes on after a quotation or bracket.
JA_GOES_ON = ["という", "といった", "といって", "として", "とは", "との", "とも", "って", "から", "まで", "など", "なら", "では", "には", "にも", "への", "より", "だけ", "しか", "ほど", "と", "を", "が", "は", "に", "で", "の", "も", "へ", "や", "か"]
#: Words that open a sentence though they begin like a particle.
JA_OPENERS = ["とにかく", "ところが", "ところで", "とりあえず", "とても", "とき", "では、", "でも", "でも、", "ですから", "だから", "はい", "はじめ", "ものの", "もし", "もちろん", "もう", "もっと", "のち", "にもかかわらず", "がんば", "から、", "やはり", "やっと", "かつて", "かなり", "かれ", "かのじょ", "それ", "これ", "しかし", "また", "そして", "さらに", "なお", "ただし", "つまり"]
JA_WORDS = [*JA_GOES_ON, *JA_OPENERS, "です", "ます", "でした", "ました", "ません", "した", "する", "して", "ある", "いる", "ない", "だ", "よ", "ね", "な", "見よ", "参照"]
#: Verbs of speech; one among the last three words after a quotation makes a reporting clause.
ZH_SPEECH = ["问道", "说道", "答道", "写道", "喊道", "叫道", "笑道", "叹道", "补充道", "回答道", "解释道", "问", "说", "答", "喊", "叫", "回答", "告诉", "抱怨", "感叹", "嘀咕", "嘟囔", "低语", "大喊", "大叫", "打招呼", "問道", "說道", "寫道", "問", "說"]
#: Verbs that make one as the last word only.
ZH_REPORTS = [*ZH_SPEECH, "写", "讲", "道", "表示", "指出", "强调", "认为", "解释", "补充", "提醒", "警告", "宣布", "透露", "承认", "否认", "寫", "回應", "宣佈"]
#: Words that open a sentence of its own after a quotation.
ZH_OPENERS = ["据", "根据", "按", "按照", "但是", "但", "不过", "然而", "因为", "由于", "所以", "因此", "如果", "虽然", "同时", "此外", "另外", "而且", "于是", "之后", "后来", "據", "根據", "但是", "因為", "所以", "如果", "雖然"]
ZH_WORDS = [*ZH_REPORTS, *ZH_OPENERS, "吗", "呢", "吧", "啊", "了", "着", "过", "的", "地", "得", "是", "在", "有", "还", "也", "就", "都", "很"]
#: Particles and words that end, and words that open, a Thai sentence.
TH_FINALS = ["แล้ว", "หรือไม่", "หรือยัง", "ไหม", "มั้ย", "ครับ", "คะ", "ค่ะ", "นะ", "จ้ะ", "เลย", "ด้วย", "เถอะ", "สิ", "ล่ะ", "เปอร์เซ็นต์", "ตามปกติ"]
TH_OPENERS = ["หลังจาก", "ก่อน", "เมื่อ", "ขณะที่", "ผู้", "แต่", "และ", "หรือ", "ดังนั้น", "เพราะ", "เพราะฉะนั้น", "อย่างไรก็ตาม", "นอกจากนี้", "ถ้า", "หาก", "แม้", "โดย", "ใน", "จาก", "ตาม", "สำหรับ", "เขา", "เธอ", "ฉัน", "ผม", "เรา", "มัน", "นี่", "นั่น", "ทุก", "บาง", "ค่า", "เจ้าหน้าที่", "ไฟล์", "บันทึก", "ตาราง", "สัญญา", "เอกสาร", "รายงาน", "ดัชนี"]
TH_WORDS = [*TH_FINALS, *TH_OPENERS, "กล่าว", "ว่า", "ได้", "คือ", "ที่", "ซึ่ง", "อัน", "วัน", "ยัง", "ใช้", "การ", "ความ", "เป็น", "มี", "ไม่", "จะ", "ให้", "ไป", "มา", "กับ", "ของ", "นี้", "นั้น", "กว่า"]
# Function words that, with a capital, open a sentence rather than go on with a name.
OPENERS = set("the a an this that these those it he she they we you i in on at by for from with after before when while because if but and or so as no not there here what who how why der die das ein eine es er sie wir le la les un une il elle ils el los las una en il lo gli o os as um uma het een".split())

#: Characters without a look that may stand before a word.
_UNSEEN = "﻿​‌‍‎‏⁠­"
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_LIST = re.compile(rf"[{_UNSEEN}]*(?:[-*•‣◦▪·–]|\(?\d{{1,3}}[.)]|\(?[a-z][.)]|\(?[^\W\d_]\)|\(?[ivx]{{1,4}}\))\s+(?=\S)")
_MARK = re.compile(rf"[{_UNSEEN}]*(?:#{{1,6}}\s+)?(?:\d{{1,3}}(?:\.\d{{1,3}})*[.)]?|[^\W\d_]\))\s+")
_CODE = re.compile(r"(?:return|def|class|import|from|if|for|while|elif|else|print|assert|raise|yield|with)\b[^.!?]*[\[\](){}:=]|[\w.]+(?:\[[^\]]*\])*\s*[-+*/|&]?=(?![=>])\s*\S|[\w.]+\([^)]*\)\s*(?:;|#|//|$)|\{.*[\"'].*\}|[|{}<].*[|{}>]$|(?!.*[.!?][\"”»)]*\s+\S).*\t.*\t|```|\$ |>>> |(?=.*[=()\[\]])[^Ͱ-Ͽ]*[;{}]$")
_CLOSERS = r"(?:[\"'”’»›)\]」』）】〉》“‘]|[   ]?(?<=[   ])»)*"
_TERMINATOR = re.compile(rf"(?:[.!?…]+(?:[   ]?[!?]+)*|(?<=[Ͱ-Ͽἀ-῿]);|[؟۔]+|[।॥]+|[。！？｡]+)((?:[\"'”’»›)\]」』）】〉》“‘]|[   ]»)*)")
_THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎])([^\S\n\r\x0b\x0c\x85  ]+|\s+)(?=[ก-ฺเ-๎])")
_SPACELESS_END = re.compile(r"[。！？｡]")
_WORD_BEFORE = re.compile(r"(\S*)$")
_ALNUM = re.compile(r"[^\W_]")
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_NEXT_WORD = re.compile(r"[^\w]*([^\W\d_]+)")
_ASKS = re.compile(rf"(?:the\s+[\w ]{{2,30}}?|(?:[A-Z][a-z]*\.\s*)*[A-Z]\w+(?:\s+(?:Ltd\.|of|and|[A-Z]\w*\.?))*)\s+{REPORTED}\b")
_OPENING = _UNSEEN + "\"'“”‘„‚«‹([{¿¡「『（【〈《—–- "
_PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》"}
_CLOSING = {v: k for k, v in _PAIRS.items()}
_BRACKET = re.compile("[" + re.escape("".join([*_PAIRS, *_CLOSING])) + "]")
_NEVER, _HARD, _SOFT = 9.0, 4.0, 1.0
#: What a sentence costs that leaves a bracket open which is closed later.
_OPEN = 3.0


#: Ranks of public vocabularies whose words, written in a spaceless script, the lattices know.
WORD_FILES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")
_SCRIPT_WORD = re.compile(r"[ก-๎]{2,}|[一-鿿]{2,}|[぀-ヿ一-鿿]{2,}")


@cache
def vocabulary_words(folder: str) -> frozenset[str]:
    """Words of two or more Thai, Han or Kana characters among the tokens of the vocabularies in a folder; none where it has no such files."""
    out = set()
    for name in WORD_FILES:
        if os.path.exists(f"{folder}/{name}"):
            for token in read_ranks(f"{folder}/{name}"):
                word = token.decode("utf-8", "ignore").strip()
                if _SCRIPT_WORD.fullmatch(word) and word.encode() in token:
                    out.add(word)
    return frozenset(out)


class Lattice:
    """Dictionary word segmentation: the cheapest path of dictionary words and single unknown characters.

    A known closed-class word costs less than one of the vocabulary, which costs less than unknown characters; longer words cost less than
    several short ones.
    """

    def __init__(self, words: list[str], more: frozenset[str] = frozenset()) -> None:
        self.cost = {w: 1.6 + 1.0 / len(w) for w in more} | {w: 1.0 + 1.0 / len(w) for w in words}
        self.longest = max(map(len, self.cost))

    def segment(self, run: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            options = [(best[end - 1][0] + 2.0, end - 1)]
            options += [(best[end - k][0] + self.cost[w], end - k) for k in range(1, min(self.longest, end) + 1) if (w := run[end - k : end]) in self.cost]
            best.append(min(options))
        out, at = [], len(run)
        while at:
            out.append(run[best[at][1] : at])
            at = best[at][1]
        return out[::-1]


@cache
def _lattices() -> tuple[Lattice, Lattice, Lattice]:
    """Japanese, Chinese and Thai, with the vocabulary's words of each script."""
    words = vocabulary_words(TOKENIZER_DIR)
    kana = frozenset(w for w in words if _KANA.search(w))
    thai = frozenset(w for w in words if "ก" <= w[0] <= "๎")
    return Lattice(JA_WORDS, kana), Lattice(ZH_WORDS, words - kana - thai), Lattice(TH_WORDS)


_KANA = re.compile(r"[぀-ヿ]")
_RUN = re.compile(r"[^\s。！？｡，、；：「『（“]*")
_SPACE = re.compile(r"\s*")
_HAN_COMMA = re.compile(r"[一-鿿]*[，、]")


def spaceless_gap_ends(body: str, m: re.Match) -> bool:
    """Whether a terminator of a spaceless script, with its closing marks, ends the sentence."""
    closers, at = m[1], _SPACE.match(body, m.end()).end()
    if not closers or at == len(body):
        return True
    ja, zh, _ = _lattices()
    run = _RUN.match(body, at)[0]
    if _KANA.match(run) or ")" in closers or "）" in closers:
        words = ja.segment(run[: 2 * ja.longest]) if run else []
        return not (words and words[0] in JA_GOES_ON) and (bool(_KANA.match(run)) or not _HAN_COMMA.match(body, at))
    # A reporting clause after the quotation that opened the sentence has a verb of speech among its last words. After a colon the quotation ends it.
    opened = max(body.rfind(c, 0, m.start()) for c in "“「『\"")
    if opened > 0 and body[opened - 1] in "：:":
        return True
    words = zh.segment(run)
    return not words or words[0] in ZH_OPENERS or not (words[-1] in ZH_REPORTS or any(w in ZH_SPEECH for w in words[-3:]))


def thai_gap_ends(body: str, m: re.Match) -> bool:
    """A space between Thai letters ends the sentence (so the task defines it); a line end does so only between a final and an opening word."""
    if not _BREAK.search(m[1]):
        return True
    thai = _lattices()[2]
    reach = 2 * thai.longest
    last, first = thai.segment(body[max(0, m.start() - reach) : m.start()]), thai.segment(body[m.end() : m.end() + reach])
    return bool(first) and first[0] in TH_OPENERS or bool(last) and last[-1] in TH_FINALS


def node_costs(body: str, m: re.Match, start: int) -> tuple[float, float] | None:
    """(cost of breaking, cost of going on) at a terminator of a spaced script; None where it is no node."""
    mark = body[m.start() : m.end() - len(m[1])]
    closers, at = m[1], m.end()
    if at < len(body) and not body[at].isspace():
        if mark[-1] in "।॥؟۔" or closers and mark[-1] in "!?" and body[at] in _OPENING:
            return 0.0, _HARD
        return None
    nxt = body[at : at + 60].lstrip()
    first = nxt.lstrip(_OPENING)[:1]
    lower = first.islower()
    if not nxt:
        return 0.0, _NEVER
    if closers and lower and nxt[0] == first:
        return _NEVER, 0.0
    if mark[-1] in "!?؟" or mark == ";":
        if closers.strip(")]） ") and _ASKS.match(nxt):
            return _NEVER, 0.0
        return 0.0, _HARD
    if mark[-1] in "।॥۔":
        return 0.0, _HARD
    if "…" in mark or len(mark) > 1:
        if len(mark) == 2 and mark == "..":
            pass
        return (_NEVER, 0.0) if lower else (0.0, _HARD)
    if closers:
        return 0.0, _HARD
    token = _WORD_BEFORE.search(body, max(0, m.start() - 24), m.start())[1].lstrip(_OPENING + "'")
    token = re.split(r"['’]", token)[-1] if "'" in token or "’" in token else token
    word = token.casefold()
    if not word:
        return (0.0, _HARD) if not nxt[:1].isdigit() and not lower else (_NEVER, 0.0)
    if word in INNER or word in TITLES and word != "fig":
        return _NEVER, 0.0
    if word in EITHER:
        if word in ("д", "п") and not re.search(r"т\.?\s*$", body[max(0, m.start() - 5) : m.start() - 1]):
            return _NEVER, 0.0
        return (_NEVER, 0.0) if lower else (0.0, _SOFT)
    if word in NUMBERED:
        if word == "т" and lower or first.isdigit():
            return _NEVER, 0.0
        return (_NEVER, 0.0) if lower or len(word) == 1 and token.islower() else (_HARD, _SOFT) if word != "no" else (0.0, _SOFT)
    opens = (w := _NEXT_WORD.match(nxt)) is not None and w[1][:1].isupper() and w[1].casefold() in OPENERS
    if len(token) == 1 and token.isalpha():
        # An initial before a name; a letter before a function word may end the sentence ("vitamin C. The").
        return (_NEVER, 0.0) if not opens or len(w[1]) == 1 else (_SOFT, 0.0)
    if _DOTTED.fullmatch(token):
        return (_NEVER, 0.0) if lower else (0.0, _SOFT) if opens else (_SOFT, 0.0)
    if token.isdigit():
        if not body[start : m.start() - len(token)].strip(_OPENING + "#*•"):
            return _NEVER, 0.0
        previous = body[max(0, m.start() - 24) : m.start() - len(token)].split()
        follows = re.match(r"[^\W\d_]+", nxt)
        if len(token) <= 2 and (follows and follows[0].casefold() in MONTHS or previous and previous[-1].casefold() in BEFORE_ORDINAL):
            return _NEVER, 0.0
    return 0.0, _HARD


def _last_open(body: str, points: list[int]) -> list[int]:
    """For each point, the place of the last bracket before it that is still open there, or -1."""
    out, depth, it = [], [], iter(_BRACKET.finditer(body))
    m = next(it, None)
    for p in points:
        while m and m.start() < p:
            if m[0] in _PAIRS:
                depth.append((m[0], m.start()))
            elif depth and depth[-1][0] == _CLOSING[m[0]]:
                depth.pop()
            m = next(it, None)
        out.append(depth[-1][1] if depth else -1)
    return out


def _best_path(body: str, nodes: list[tuple[int, float, float]]) -> list[int]:
    """The break positions of the cheapest path through the nodes (position, cost of breaking, cost of going on).

    One forward pass, however long a sentence is: the cost of going on is a running sum, so an edge from any earlier node costs that node's
    value plus one term; a stack of rising values gives the best node after the last bracket still open, from where the
    edge has no bracket open. Of equal paths the one with the longer last sentence is taken.
    """
    points = [(0, 0.0, 0.0), *nodes]
    opened = _last_open(body, [p for p, _, _ in points]) if any(c in body for c in _PAIRS) else None
    total = 0.0
    values, places, indices = [0.0], [0], [0]  # rising values of earlier nodes, less the cost of going on up to them
    best = [(0.0, 0)]
    for i in range(1, len(points)):
        place, breaking, going = points[i]
        options = [(values[0] + total + breaking + (_OPEN if opened and opened[i] >= places[0] else 0.0), indices[0])]
        if opened and opened[i] >= places[0] and (k := bisect_right(places, opened[i])) < len(places):
            options.append((values[k] + total + breaking, indices[k]))
        best.append(min(options))
        total += going
        own = best[i][0] - total
        while values and values[-1] > own:
            values.pop()
            places.pop()
            indices.pop()
        values.append(own)
        places.append(place)
        indices.append(i)
    at, out = len(points) - 1, []
    while at:
        out.append(points[at][0])
        at = best[at][1]
    return out[::-1]


def block_ends(body: str) -> list[int]:
    """Ends of the sentences of one block (no white space around it)."""
    n = len(body)
    lines = _BREAK.split(body)
    if _LIST.match(body) or body[0] in "#|{" or all(_CODE.match(x.strip()) for x in lines):
        return [n]
    start = m.end() if (m := _MARK.match(body)) and len(lines) == 1 and not _TERMINATOR.search(body, m.end(), n) else 0
    nodes: dict[int, tuple[float, float]] = {}
    for m in _TERMINATOR.finditer(body, start):
        if _SPACELESS_END.match(m[0]):
            ends = spaceless_gap_ends(body, m)
            nodes[m.end()] = (0.0, _HARD) if ends else (_NEVER, 0.0)
        elif (cost := node_costs(body, m, start)) is not None:
            nodes[m.end()] = cost
    for m in _THAI_GAP.finditer(body):
        if thai_gap_ends(body, m):
            nodes.setdefault(m.start(), (0.0, _HARD))
    nodes.setdefault(n, (0.0, _NEVER))
    nodes[n] = (0.0, _NEVER)
    out: list[int] = []
    last = 0
    for end in _best_path(body, [(p, *nodes[p]) for p in sorted(nodes)]):
        if out and not _ALNUM.search(body, last, end):
            out[-1] = end
        else:
            out.append(end)
        last = end
    return out


def sentence_ends(text: str | None) -> list[int]:
    """End positions of the sentences of a text, ascending."""
    if not text:
        return []
    out: list[int] = []
    at, begin, end = 0, None, 0
    # Lines with their places; blank lines close a block.
    for m in [*_BREAK.finditer(text), None]:
        line_end = m.start() if m else len(text)
        line = text[at:line_end]
        inner = line.strip()
        if inner:
            first = at + len(line) - len(line.lstrip())
            begin = first if begin is None else begin
            end = first + len(inner)
        if begin is not None and (not inner or m is None):
            out += [begin + e for e in block_ends(text[begin:end])]
            begin = None
        at = m.end() if m else at
    return out


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, sentence, end_pos[, start_pos, sentence_text]): one row per sentence, read where the text lies, without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            ends = [sentence_ends(t) for t in texts]
            counts = np.fromiter(map(len, ends), dtype=np.int64, count=len(ends))
            columns = {id_col: batch.column(0).take(pa.array(np.repeat(np.arange(len(ends)), counts)))}
            columns["sentence"] = pa.array([i for own in ends for i in range(len(own))], pa.int32())
            columns["end_pos"] = pa.array([e for own in ends for e in own], pa.int64())
            if with_text:
                starts, words = [], []
                for t, own in zip(texts, ends):
                    last = 0
                    for e in own:
                        piece = t[last:e]
                        s = last + len(piece) - len(piece.lstrip())
                        starts.append(s)
                        words.append(t[s:e])
                        last = e
                columns["start_pos"] = pa.array(starts, pa.int64())
                columns["sentence_text"] = pa.array(words, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ddl = f"`{id_col}` {kind}, sentence int, end_pos bigint" + (", start_pos bigint, sentence_text string" if with_text else "")
    return df.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, ddl)
