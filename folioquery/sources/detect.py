"""Format detection: a ladder of evidence from leading bytes, content and extension, as Columns over (content, path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format tokens with their media types and extensions.
MEDIA = {
    "html": ("text/html", ("html", "htm", "xhtml")),
    "md": ("text/markdown", ("md", "markdown")),
    "txt": ("text/plain", ("txt", "text", "log")),
    "json": ("application/json", ("json",)),
    "jsonl": ("application/jsonl", ("jsonl", "ndjson")),
    "ipynb": ("application/x-ipynb+json", ("ipynb",)),
    "tsv": ("text/tab-separated-values", ("tsv",)),
    "csv": ("text/csv", ("csv",)),
    "xml": ("application/xml", ("xml",)),
    "svg": ("image/svg+xml", ("svg",)),
    "pdf": ("application/pdf", ("pdf",)),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ("docx",)),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", ("pptx",)),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ("xlsx",)),
    "odt": ("application/vnd.oasis.opendocument.text", ("odt",)),
    "rtf": ("application/rtf", ("rtf",)),
    "epub": ("application/epub+zip", ("epub",)),
    "zip": ("application/zip", ("zip",)),
    "gz": ("application/gzip", ("gz", "tgz")),
}
#: Leading bytes in hex.
MAGIC = {"25504446": "pdf", "504B0304": "zip", "1F8B": "gz", "7B5C727466": "rtf"}
HEAD_BYTES = 8192


def by_extension(path: Column) -> Column:
    """The format token of a path's extension; null for an unknown one."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(x) for token, (_, exts) in MEDIA.items() for e in exts for x in (e, token)]
    return F.element_at(F.create_map(*pairs), ext)


def media_type(token: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for token_, (m, _) in MEDIA.items() for x in (token_, m)]), token)


def by_magic(content: Column) -> Column:
    """The format token of the leading bytes; null if none fits."""
    start = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*[F.when(F.startswith(start, F.lit(m)), F.lit(t)) for m, t in MAGIC.items()])


def by_content(text: Column) -> Column:
    """The format token the text itself suggests, from its head; plain text otherwise."""
    head = F.ltrim(F.substring(text, 1, HEAD_BYTES))
    return (
        F.when(head.rlike(r"(?i)^<!doctype html|^<html"), "html")
        .when(head.rlike(r"^<svg"), "svg")
        .when(head.rlike(r"^<\?xml|^<[A-Za-z][^>]*>"), "xml")
        .when(head.rlike(r'^\{[^\n]*\}\n\{'), "jsonl")
        .when(head.rlike(r"^[\[{]"), "json")
        .when(head.rlike(r"(?m)^#{1,6} \S|^```|^[-*] \S"), "md")
        .when(head.rlike(r"^[^\n\t]+\t[^\n]+\n[^\n\t]+\t"), "tsv")
        .otherwise("txt")
    )


def detect(path: Column, content: Column, declared: Column | None = None) -> Column:
    """struct(format, basis): magic before content that is not plain, before extension, before what was declared."""
    guess = by_content(content.cast("string"))
    steps = [(by_magic(content), "magic"), (F.when(guess != "txt", guess), "content"), (by_extension(path), "extension"), (declared if declared is not None else F.lit(None).cast("string"), "declared"), (guess, "content")]
    return F.coalesce(*[F.when(f.isNotNull(), F.struct(f.alias("format"), F.lit(b).alias("basis"))) for f, b in steps])
