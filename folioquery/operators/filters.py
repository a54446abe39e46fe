"""Head views, query filters, restriction masks, three-valued rule predicates and ordered rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix_range


def block_head(block: DataFrame, doc: DataFrame, only: Filters | None = None, where: Column | None = None) -> DataFrame:
    """The live blocks of each document's head generation; rows delivered twice count once (by block_id, the latest written).

    A delivery repeats its row, all but the time it was written, so conditions hold for all deliveries of a block or for none. `only` and `where`
    are therefore tested before the deliveries are counted, on the scan.
    """
    heads, live = doc.select("doc_ord", "gen"), block.where("state = 0")
    if only is not None:
        live = narrow(live, only)
        heads = narrow(doc, only).select("doc_ord", "gen")
    live = live.where(where) if where is not None else live
    live = live.join(heads, ["doc_ord", "gen"])
    # One aggregate a column: those that a query does not read are pruned down to the scan.
    written = F.coalesce("written_at", F.lit("1970-01-01").cast("timestamp"))
    return live.groupBy("block_id").agg(*[F.max_by(c, written).alias(c) for c in block.columns if c != "block_id"])


@dataclass(frozen=True)
class Filters:
    """The fields of a query filter; None restricts nothing. Layers default to the body."""

    doc_ords: tuple[int, ...] | None = None
    uri_prefix: str | None = None
    formats: tuple[str, ...] | None = None
    kinds: tuple[str, ...] | None = None
    layers: tuple[str, ...] | None = ("body",)
    pages: tuple[int, int] | None = None
    section_prefix: str | None = None
    lang: str | None = None
    min_trust: int | None = None
    min_quote: int | None = None
    deny_methods: tuple[str, ...] | None = None
    deny_bits: int = 0
    extra: tuple[Column, ...] = field(default=())

    def predicates(self, available: set[str]) -> list[Column]:
        """One predicate per set field whose column the frame has; all are plain comparisons, so they reach the scan."""
        c = F.col
        options = [
            ("doc_ord", self.doc_ords, lambda v: c("doc_ord").isin(*v)),
            ("uri", self.uri_prefix, lambda v: F.startswith("uri", F.lit(v))),
            ("format", self.formats, lambda v: c("format").isin(*v)),
            ("kind", self.kinds, lambda v: c("kind").isin(*v)),
            ("layer", self.layers, lambda v: c("layer").isin(*v)),
            ("page", self.pages, lambda v: c("page").between(*v)),
            ("sec_path", self.section_prefix, lambda v: prefix_range(c("sec_path"), v)),
            ("lang", self.lang, lambda v: c("lang") == v),
            ("trust", self.min_trust, lambda v: c("trust") >= v),
            ("quote", self.min_quote, lambda v: c("quote") >= v),
            ("method", self.deny_methods, lambda v: ~c("method").isin(*v)),
            ("restriction_bits", self.deny_bits or None, lambda v: c("restriction_bits").bitwiseAND(F.lit(v)) == 0),
        ]
        return [make(value) for name, value, make in options if value is not None and name in available] + list(self.extra)


def narrow(df: DataFrame, filters: Filters) -> DataFrame:
    """The rows that pass every field of the filter."""
    return reduce(lambda out, p: out.where(p), filters.predicates(set(df.columns)), df)


def withheld(df: DataFrame, filters: Filters, bits: tuple[int, ...]) -> DataFrame:
    """(bit, withheld): of the rows that pass all but the restriction mask, how many each denied bit withholds."""
    open_ = Filters(**{**filters.__dict__, "deny_bits": 0})
    rows = narrow(df, open_)
    counts = rows.agg(*[F.count_if(F.col("restriction_bits").bitwiseAND(F.lit(b)) != 0).alias(f"b{b}") for b in bits])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(b).cast("bigint").alias("bit"), F.col(f"b{b}").alias("withheld")) for b in bits])).alias("x")).select("x.*")


OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "exists": lambda c, v: c.isNotNull() == bool(v),
}


def predicate(column: str, op: str, value) -> Column:
    """A test of one piece of evidence; missing evidence is unknown (null), but for `exists`."""
    return OPERATORS[op](F.col(column), value)


def clause(all_of: list[Column] = (), any_of: list[Column] = (), none_of: list[Column] = ()) -> Column:
    """Kleene logic over tests: false beats unknown."""
    parts = [*all_of, *([reduce(lambda a, b: a | b, any_of)] if any_of else []), *[~x for x in none_of]]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def first_rule(rules: list[tuple[str, Column, str]], default: str) -> Column:
    """The name of the first rule that fires; each is (name, condition, on_unknown in skip, match, defer)."""
    out = None
    for name, condition, unknown in rules:
        fires = F.coalesce(condition, F.lit(unknown == "match"))
        out = F.when(fires, name) if out is None else out.when(fires, name)
        if unknown == "defer":
            out = out.when(condition.isNull(), "deferred:" + name)
    return out.otherwise(default) if out is not None else F.lit(default)
