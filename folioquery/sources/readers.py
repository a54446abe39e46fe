"""Readers: text of one document -> blocks (ord, kind, level, text), for plain text, Markdown, HTML, XML, JSON, notebooks and tab-separated rows.

read_blocks() runs them over a frame of (id, format, text) in Arrow batches; a document that cannot be read gives one block of kind
'unreadable' and no failure. Null and empty texts give no block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Block = tuple[str, int | None, str]  # kind, level, text
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding): by byte-order mark, else UTF-8, else Latin-1; control characters but tab and line end go."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return _CONTROL.sub("", data[len(mark) :].decode(name, "replace")), name
    try:
        return _CONTROL.sub("", data.decode("utf-8")), "utf-8"
    except UnicodeDecodeError:
        return _CONTROL.sub("", data.decode("latin-1")), "latin-1"


def read_text(text: str) -> list[Block]:
    return [("paragraph", None, p.strip()) for p in re.split(r"\n[ \t]*\n", text) if p.strip()]


def read_markdown(text: str) -> list[Block]:
    out: list[Block] = []
    para: list[str] = []

    def close() -> None:
        if para:
            out.append(("paragraph", None, "\n".join(para)))
            para.clear()

    lines = iter(text.splitlines())
    for line in lines:
        if m := re.match(r"\s*(```|~~~)", line):
            close()
            code = []
            for inner in lines:
                if inner.strip().startswith(m[1]):
                    break
                code.append(inner)
            out.append(("code", None, "\n".join(code)))
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            close()
            out.append(("heading", len(m[1]), m[2]))
        elif m := re.match(r"(\s*)(?:[-*+•]|\d+[.)])\s+(.*)", line):
            close()
            out.append(("list_item", len(m[1]) // 2 + 1, m[2]))
        elif line.lstrip().startswith("|") and line.rstrip().endswith("|"):
            close()
            if not re.fullmatch(r"[\s|:-]+", line):
                out.append(("table_row", None, "\t".join(c.strip() for c in line.strip().strip("|").split("|"))))
        elif line.startswith(">"):
            close()
            out.append(("blockquote", None, line.lstrip("> ")))
        elif line.strip():
            para.append(line)
        else:
            close()
    close()
    return out


class _Html(HTMLParser):
    KINDS = {"p": "paragraph", "li": "list_item", "pre": "code", "blockquote": "blockquote", "figcaption": "caption", "caption": "caption", "td": "table_cell", "th": "table_cell", "title": "title", "div": "paragraph", "section": "paragraph", "body": "paragraph"}
    SKIP = {"script", "style", "template", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.kind, self.level, self.buffer, self.skip, self.depth = "paragraph", None, [], 0, 0

    def flush(self) -> None:
        raw = "".join(self.buffer)
        words = raw.strip("\n") if self.kind == "code" else " ".join(raw.split())
        if words.strip():
            self.out.append((self.kind, self.level, words))
        self.buffer, self.kind, self.level = [], "paragraph", None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag in ("ul", "ol"):
            self.flush()
            self.depth += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag in self.KINDS:
            self.flush()
            self.kind, self.level = self.KINDS[tag], self.depth if tag == "li" else None
        elif tag == "br":
            self.buffer.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            self.flush()
            self.depth = max(0, self.depth - 1)
        elif tag in self.KINDS or re.fullmatch(r"h[1-6]", tag):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.buffer.append(data)


def read_html(text: str) -> list[Block]:
    parser = _Html()
    parser.feed(text)
    parser.close()
    parser.flush()
    return parser.out


def read_xml(text: str) -> list[Block]:
    return [("paragraph", None, " ".join(t.split())) for t in ElementTree.fromstring(text).itertext() if t.strip()]


def _leaves(value, path: str) -> Iterator[Block]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{i}]")
    else:
        yield ("paragraph", None, f"{path}: {value}" if path else str(value))


def read_json(text: str) -> list[Block]:
    return list(_leaves(json.loads(text), ""))


def read_jsonl(text: str) -> list[Block]:
    return [b for line in text.splitlines() if line.strip() for b in _leaves(json.loads(line), "")]


def read_notebook(text: str) -> list[Block]:
    out: list[Block] = []
    for cell in json.loads(text).get("cells", []):
        source = "".join(cell.get("source", []))
        out += read_markdown(source) if cell.get("cell_type") == "markdown" else [("code", None, source)] if source else []
        for o in cell.get("outputs", []):
            words = "".join(o.get("text", [])) or "".join(o.get("data", {}).get("text/plain", []))
            if words:
                out.append(("output", None, words))
    return out


def read_tsv(text: str) -> list[Block]:
    return [("table_row", None, line) for line in text.splitlines() if line.strip()]


READERS = {"txt": read_text, "md": read_markdown, "html": read_html, "xml": read_xml, "svg": read_xml, "json": read_json, "jsonl": read_jsonl, "ipynb": read_notebook, "tsv": read_tsv}


def read_blocks(df: DataFrame, id_col: str, format_col: str, text_col: str) -> DataFrame:
    """(id, ord, kind, level, text): one row per block, where the texts lie, without a shuffle."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (form, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not text:
                    continue
                try:
                    blocks = READERS.get(form, read_text)(text)
                except Exception as problem:  # noqa: BLE001
                    blocks = [("unreadable", None, type(problem).__name__)]
                at += [i] * len(blocks)
                rows += [(n, *b) for n, b in enumerate(blocks)]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.string())))], names=[id_col, "ord", "kind", "level", "text"])

    return df.select(id_col, format_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ord int, kind string, level int, text string")


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, text): blank-line separated paragraphs, inside the JVM."""
    parts = F.filter(F.transform(F.split(text_col, r"\n[ \t]*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(parts).alias("ord", "text"))


def render_markdown(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id, markdown): the blocks of a document (ord, kind, level, text) as one text; a document is one row by its nature."""
    mark = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "))).when(F.col("kind") == "list_item", "- ").when(F.col("kind") == "blockquote", "> ").otherwise("")
    body = F.when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).when(F.col("kind") == "table_row", F.concat(F.lit("| "), F.regexp_replace("text", "\t", " | "), F.lit(" |"))).otherwise(F.concat(mark, F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct("ord", body.alias("line"))))
    return blocks.groupBy(id_col).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("markdown"))
