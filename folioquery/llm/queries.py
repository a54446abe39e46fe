"""The pN_ queries of the eight training-data problems, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import lookalike, neighbours, ocr, packing, quantiles, sentences, splitting, tokens

VERDICT_KEY = (["run_id", "assertion_id", "evaluator"], "loaded_at")
MEASURES = ["wall_ms", "micros"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.heavy_tails(table(spark, d, "eval_verdict"), "slice_key", MEASURES, VERDICT_KEY)


def p1_percentiles_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Sketches per slice and day of the run, merged to slices over all days; with brackets of certain bound."""
    run = table(spark, d, "eval_run").select("run_id", F.date_from_unix_date((F.col("started_ns") / 86_400_000_000_000).cast("int")).alias("day"))
    verdict = table(spark, d, "eval_verdict").join(run, "run_id", "left")
    daily = quantiles.sketches(verdict, ["slice_key", "day"], MEASURES, distinct_on=VERDICT_KEY)
    return quantiles.percentiles(daily, ["slice_key"], [0.5, 0.9, 0.95, 0.99])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.quotation_twins(*(table(spark, d, t) for t in ("eval_assertion", "block", "doc")))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every block's text."""
    return lookalike.canonical_form(table(spark, d, "block").select("block_id", "text"), "text").select("block_id", "canonical")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.mutual_pairs(table(spark, d, "vfull"), table(spark, d, "embed_space"), 0.90)


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of every vector."""
    return neighbours.neighbours(table(spark, d, "vfull"), table(spark, d, "embed_space"))


def _split(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    return splitting.split_pending(*(table(spark, d, t) for t in ("vpending", "segment", "block", "embed_space")), with_text)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(_split(spark, d, False))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every pending segment, with its place and text."""
    return _split(spark, d, True).select("model_key", "segment_digest", F.posexplode("pieces").alias("piece", "p")).select("model_key", "segment_digest", "piece", "p.*")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.noise(table(spark, d, "block"), table(spark, d, "doc"))


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    """The scanned documents as repaired, continuous paragraphs."""
    return ocr.paragraphs(table(spark, d, "block"), table(spark, d, "doc"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, d))


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every non-empty text is packed once, whole, in containers that hold it."""
    return packing.coverage(p7_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents")).select("doc_id", "end_pos")


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document with its place and text."""
    return sentences.split_sentences(table(spark, d, "documents"), with_text=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _look_sql(x: str) -> str:
    """DuckDB expression for the mapped and composed form of x."""
    single, several = lookalike.look_table()
    keep = [c for c in single if single[c]]
    gone = [c for c in single if not single[c] and ord(c)]
    out = f"translate({x}, {_quote(''.join(keep + gone))}, {_quote(''.join(single[c] for c in keep))})"
    for c in lookalike.SEVERAL:
        out = f"replace({out}, {_quote(c)}, {_quote(several[c])})"
    return f"nfc_normalize({out})"


def _odd_sql(x: str) -> str:
    """DuckDB ORDER BY terms of lookalike.oddity()."""
    other = "\\p{Cyrillic}\\p{Greek}\\p{Armenian}\\p{Cherokee}\\p{Coptic}\\p{Lisu}"
    mixed = f"(\\p{{Latin}}[\\p{{L}}\\p{{M}}]*[{other}]|[{other}][\\p{{L}}\\p{{M}}]*\\p{{Latin}})"
    odd = lookalike.odd_characters().replace(chr(0), "")
    return f"len(regexp_extract_all({x}, '{mixed}')), length({x}) - length(translate({x}, {_quote(odd)}, '')), len(regexp_extract_all({x}, '\\p{{Mn}}')), {x}"


def oracle_sql() -> dict[str, str]:
    packed_once = "SELECT doc_id, true AS whole, true AS sound FROM documents WHERE text <> ''"
    stretch = "[\\s.!?;:,。！？；：、।؟]"
    once = "SELECT DISTINCT run_id, assertion_id, evaluator, slice_key, wall_ms, micros FROM eval_verdict"
    return {
        "p1_found": f"""
            WITH v AS ({once}),
            m AS (SELECT slice_key, 'wall_ms' AS measure, wall_ms AS x FROM v UNION ALL SELECT slice_key, 'micros', micros FROM v),
            r AS (SELECT slice_key, measure, x, row_number() OVER w AS i, count(*) OVER (PARTITION BY slice_key, measure) AS n
                  FROM m WHERE x IS NOT NULL WINDOW w AS (PARTITION BY slice_key, measure ORDER BY x)),
            q AS (SELECT slice_key, measure, min(x) FILTER (WHERE i * 2 >= n) AS med, min(x) FILTER (WHERE i * 100 >= n * 95) AS p95
                  FROM r GROUP BY slice_key, measure)
            SELECT slice_key, measure FROM q WHERE med > 0 AND p95 >= 20 * med""",
        "p2_found": f"""
            WITH a AS (SELECT DISTINCT assertion_id, doc, page, json_extract_string(spec, '$.text') AS q FROM eval_assertion WHERE type = 'present')
            SELECT DISTINCT a.assertion_id, b.block_id FROM a JOIN doc d ON d.uri = a.doc
            JOIN block b ON b.doc_ord = d.doc_ord AND b.gen = d.gen AND b.page = a.page AND b.state = 0
            WHERE b.text <> a.q AND {_look_sql("b.text")} = {_look_sql("a.q")}""",
        "p2_canonical": f"""
            WITH t AS (SELECT text, {_look_sql("text")} AS m FROM (SELECT DISTINCT text FROM block WHERE text IS NOT NULL)),
            f AS (SELECT m, text AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY {_odd_sql("text")}) AS r FROM t) WHERE r = 1)
            SELECT b.block_id, f.canonical FROM block b LEFT JOIN t ON t.text = b.text LEFT JOIN f ON f.m = t.m""",
        "p3_found": """
            WITH u AS (SELECT f.model_key, f.segment_digest AS g, min(f.v) AS v FROM vfull f JOIN embed_space s ON s.model_key = f.model_key AND len(f.v) = s.dim
                       WHERE len(list_filter(f.v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(f.v, lambda x: x <> 0)) > 0 GROUP BY ALL),
            c AS (SELECT a.model_key, a.g AS a, b.g AS b, list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS cos FROM u a JOIN u b ON a.model_key = b.model_key AND a.g <> b.g),
            k AS (SELECT *, row_number() OVER (PARTITION BY model_key, a ORDER BY cos DESC, b) AS r FROM c WHERE cos >= 0.9)
            SELECT x.model_key, x.a AS segment_digest_a, x.b AS segment_digest_b FROM k x JOIN k y ON x.model_key = y.model_key AND x.a = y.b AND x.b = y.a
            WHERE x.a < x.b AND x.r <= 10 AND y.r <= 10""",
        "p7_coverage": packed_once,
        "p4_found": f"""
            WITH m AS (SELECT content_digest, unnest(member_ids) AS block_id, generate_subscripts(member_ids, 1) AS i FROM segment),
            b AS (SELECT DISTINCT block_id, coalesce(text, '') AS text FROM block),
            t AS (SELECT content_digest, string_agg(text, chr(10) ORDER BY i) AS text FROM m JOIN b USING (block_id) GROUP BY content_digest),
            p AS (SELECT DISTINCT model_key, segment_digest FROM vpending)
            SELECT p.model_key, p.segment_digest,
                   CAST(list_max(list_transform(regexp_split_to_array(t.text, '{stretch}'), lambda x: length(x))) > s.max_chars AS INTEGER) AS forced
            FROM p JOIN embed_space s USING (model_key) JOIN t ON t.content_digest = p.segment_digest WHERE length(t.text) > s.max_chars""",
    }
