"""More reports: generations compared, budgets and caches, calibration bins, grids, names in text, emissions of sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gazetteer, tables
from ..session import table
from .catalog import query
from .reports import _HEAD, _VERDICT, head, verdicts

_NEW = "n AS (SELECT DISTINCT doc_ord, addr, content_digest FROM block WHERE state = 0), o AS (SELECT DISTINCT doc_ord, addr, content_digest FROM block WHERE state = 1)"


@query(
    "doc_diff",
    f"""WITH {_NEW} SELECT coalesce(n.doc_ord, o.doc_ord) AS doc_ord, coalesce(n.addr, o.addr) AS addr, CASE WHEN o.addr IS NULL THEN 'created' WHEN n.addr IS NULL THEN 'retired' WHEN n.content_digest = o.content_digest THEN 'carried' ELSE 'revised' END AS change
        FROM n FULL JOIN o ON n.doc_ord = o.doc_ord AND n.addr = o.addr WHERE coalesce(n.doc_ord, o.doc_ord) IN (SELECT doc_ord FROM o)""",
)
def doc_diff(spark, d):
    """What became of each address of the documents that have more than one generation."""
    b = table(spark, d, "block").select("doc_ord", "addr", "content_digest", "state").distinct()
    old, new = (b.where(f"state = {s}").select("doc_ord", "addr", F.col("content_digest").alias(n)) for s, n in ((1, "old"), (0, "new")))
    both = new.join(old, ["doc_ord", "addr"], "full").join(old.select("doc_ord").distinct(), "doc_ord", "left_semi")
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "retired").when(F.col("new") == F.col("old"), "carried").otherwise("revised")
    return both.select("doc_ord", "addr", change.alias("change"))


@query(
    "churn_class",
    """WITH k AS (SELECT DISTINCT block_id, doc_ord, kind, state FROM block), n AS (SELECT doc_ord, kind, count(*) AS now FROM k WHERE state = 0 GROUP BY ALL), o AS (SELECT doc_ord, kind, count(*) AS was FROM k WHERE state = 1 GROUP BY ALL),
       x AS (SELECT doc_ord, kind, coalesce(now, 0) AS now, coalesce(was, 0) AS was FROM n FULL JOIN o USING (doc_ord, kind) WHERE doc_ord IN (SELECT doc_ord FROM o))
       SELECT doc_ord, CASE WHEN count(*) FILTER (WHERE now <> was) = 0 THEN 'same' WHEN count(*) FILTER (WHERE now = 0 OR was = 0) > 0 THEN 'reshaped' ELSE 'counts' END AS class FROM x GROUP BY doc_ord""",
)
def churn_class(spark, d):
    """How the counts of kinds moved between a document's generations."""
    k = table(spark, d, "block").select("block_id", "doc_ord", "kind", "state").distinct()
    n = k.groupBy("doc_ord", "kind").agg(F.count_if(F.col("state") == 0).alias("now"), F.count_if(F.col("state") == 1).alias("was"))
    x = n.join(k.where("state = 1").select("doc_ord").distinct(), "doc_ord", "left_semi")
    moved, lost = F.count_if(F.col("now") != F.col("was")), F.count_if((F.col("now") == 0) | (F.col("was") == 0))
    return x.groupBy("doc_ord").agg(F.when(moved == 0, "same").when(lost > 0, "reshaped").otherwise("counts").alias("class"))


@query(
    "structure_f1",
    f"""WITH {_NEW}, t AS (SELECT doc_ord, count(*) AS found FROM n GROUP BY 1), g AS (SELECT doc_ord, count(*) AS gold FROM o GROUP BY 1), m AS (SELECT n.doc_ord, count(*) AS hit FROM n JOIN o ON n.doc_ord = o.doc_ord AND n.content_digest = o.content_digest AND n.addr = o.addr GROUP BY 1)
        SELECT g.doc_ord, round(2 * coalesce(hit, 0) / (coalesce(found, 0) + gold), 9) AS f1 FROM g LEFT JOIN t ON t.doc_ord = g.doc_ord LEFT JOIN m ON m.doc_ord = g.doc_ord""",
)
def structure_f1(spark, d):
    """F1 of the head's (address, content) pairs against the retired generation's."""
    b = table(spark, d, "block").select("doc_ord", "addr", "content_digest", "state").distinct()
    x = b.groupBy("doc_ord", "addr", "content_digest").agg(F.bool_or(F.col("state") == 0).alias("new"), F.bool_or(F.col("state") == 1).alias("old"))
    y = x.groupBy("doc_ord").agg(F.count_if("new").alias("found"), F.count_if("old").alias("gold"), F.count_if(F.col("new") & F.col("old")).alias("hit")).where("gold > 0")
    return y.select("doc_ord", F.round(2 * F.col("hit") / (F.col("found") + F.col("gold")), 9).alias("f1"))


@query("doc_shape", f"SELECT doc_ord, 'kind.' || kind AS key, count(*) AS value FROM ({_HEAD}) GROUP BY ALL UNION ALL SELECT doc_ord, 'layer.' || layer, count(*) FROM ({_HEAD}) GROUP BY ALL UNION ALL SELECT doc_ord, 'trust.' || trust, count(*) FROM ({_HEAD}) GROUP BY ALL")
def doc_shape(spark, d):
    """Each document reduced to counters, in one pass over its blocks."""
    keys = F.explode(F.array(*[F.concat(F.lit(f"{c}."), F.col(c).cast("string")) for c in ("kind", "layer", "trust")])).alias("key")
    return head(spark, d).select("doc_ord", keys).groupBy("doc_ord", "key").agg(F.count("*").alias("value"))


@query("admission", "SELECT run_id, CASE WHEN running <= 40000000 THEN 'admitted' WHEN running - spend_micros < 40000000 THEN 'degraded' ELSE 'deferred' END AS verdict FROM (SELECT run_id, spend_micros, sum(spend_micros) OVER (PARTITION BY suite ORDER BY started_ns, run_id ROWS UNBOUNDED PRECEDING) AS running FROM eval_run WHERE spend_micros IS NOT NULL)")
def admission(spark, d):
    """Runs admitted in order of arrival up to a budget per suite."""
    order = Window.partitionBy("suite").orderBy("started_ns", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, d, "eval_run").where("spend_micros IS NOT NULL").withColumn("running", F.sum("spend_micros").over(order))
    limit = 40_000_000
    return r.select("run_id", F.when(F.col("running") <= limit, "admitted").when(F.col("running") - F.col("spend_micros") < limit, "degraded").otherwise("deferred").alias("verdict"))


@query("headroom", "SELECT suite, CAST(greatest(0, least(900000000, 1000000000 - coalesce(sum(spend_micros) FILTER (WHERE ended_ns IS NOT NULL), 0) - 50000 * count(*) FILTER (WHERE ended_ns IS NULL))) AS BIGINT) AS micros FROM eval_run GROUP BY suite")
def headroom(spark, d):
    """The budget left per suite: less what ended runs spent and what open runs hold."""
    ended = F.col("ended_ns").isNotNull()
    left = 1_000_000_000 - F.coalesce(F.sum(F.when(ended, F.col("spend_micros"))), F.lit(0)) - 50_000 * F.count_if(~ended)
    return table(spark, d, "eval_run").groupBy("suite").agg(F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(900_000_000).cast("bigint"), left)).alias("micros"))


@query(
    "cache_verdict",
    """WITH p AS (SELECT DISTINCT model_key, segment_digest FROM vpending), f AS (SELECT f.model_key, f.segment_digest, bool_or(f.v IS NOT NULL AND len(f.v) = s.dim) AS good FROM vfull f JOIN embed_space s USING (model_key) GROUP BY ALL)
       SELECT p.model_key, CASE WHEN f.segment_digest IS NULL THEN 'miss' WHEN f.good THEN 'hit' ELSE 'unusable' END AS verdict, count(*) AS n FROM p LEFT JOIN f ON f.model_key = p.model_key AND f.segment_digest = p.segment_digest GROUP BY ALL""",
)
def cache_verdict(spark, d):
    """Whether waiting segments are in the cache after all."""
    keys = ["model_key", "segment_digest"]
    space = table(spark, d, "embed_space").select("model_key", "dim")
    f = table(spark, d, "vfull").join(space, "model_key").groupBy(*keys).agg(F.bool_or(F.col("v").isNotNull() & (F.size("v") == F.col("dim"))).alias("good"))
    p = table(spark, d, "vpending").select(*keys).distinct()
    return p.join(f, keys, "left").groupBy("model_key", F.when(F.col("good").isNull(), "miss").when(F.col("good"), "hit").otherwise("unusable").alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "equal_mass_bins",
    f"""WITH v AS (SELECT round(score, 3) AS score, count(*) AS n, sum(passed) AS k FROM ({_VERDICT}) WHERE score IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS before, sum(n) OVER () AS total FROM v)
        SELECT CAST(floor(before * 10 / total) AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, min(score) AS low, max(score) AS high FROM c GROUP BY 1""",
)
def equal_mass_bins(spark, d):
    """Ten bins of nearly equal size that never part equal scores: cut over scores of three decimals, of which there are at most 1,001."""
    v = verdicts(spark, d).where("score IS NOT NULL").groupBy(F.round("score", 3).alias("score")).agg(F.count("*").alias("n"), F.sum("passed").alias("k"))
    whole = v.agg(F.sum("n").alias("total"))
    order = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    c = v.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).crossJoin(whole)
    return c.groupBy(F.floor(F.col("before") * 10 / F.col("total")).cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("open_context", f"SELECT block_id, lag(block_id) OVER w AS before, lead(block_id) OVER w AS after FROM ({_HEAD}) WINDOW w AS (PARTITION BY doc_ord, page ORDER BY ord, block_id)")
def open_context(spark, d):
    """The siblings beside each block on its page."""
    w = Window.partitionBy("doc_ord", "page").orderBy("ord", "block_id")
    return head(spark, d).select("block_id", F.lag("block_id").over(w).alias("before"), F.lead("block_id").over(w).alias("after"))


@query("daily_cost", "WITH x AS (SELECT CAST(started_ns // 86400000000000 AS BIGINT) AS day, suite, coalesce(spend_micros, 0) AS micros FROM eval_run) SELECT day, suite, CAST(sum(micros) AS BIGINT) AS micros, count(*) AS runs FROM x GROUP BY day, suite UNION ALL SELECT day, '__all__', CAST(sum(micros) AS BIGINT), count(*) FROM x GROUP BY day")
def daily_cost(spark, d):
    """Spend by day and suite, with a row for all suites, from one pass."""
    x = table(spark, d, "eval_run").select(F.expr("started_ns div 86400000000000").alias("day"), F.explode(F.array("suite", F.lit("__all__"))).alias("suite"), F.coalesce("spend_micros", F.lit(0)).alias("micros"))
    return x.groupBy("day", "suite").agg(F.sum("micros").alias("micros"), F.count("*").alias("runs"))


def order_grid(spark, d):
    """Orders as tables: a line a row, three columns."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("r"), F.array("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("t"), "l_partkey", "l_suppkey")
    first = line.groupBy("table_id", "r").agg(F.min(F.struct("l_partkey", "l_suppkey", "t")).alias("x")).select("table_id", "r", F.posexplode("x.t").alias("c", "text"))
    return first


_GRID = "g AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS r, arg_min([l_returnflag, l_linestatus, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)], (l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR))) AS t FROM lineitem GROUP BY ALL), c AS (SELECT table_id, r, CAST(unnest([0, 1, 2]) AS INTEGER) AS c, unnest(t) AS text FROM g)"


@query("grid_neighbours", f"WITH {_GRID} SELECT a.table_id, CAST(a.r AS INTEGER) AS r, a.c, b.text AS below FROM c a LEFT JOIN c b ON b.table_id = a.table_id AND b.r = a.r + 1 AND b.c = a.c")
def grid_neighbours(spark, d):
    cells = order_grid(spark, d).select("table_id", "r", "c", F.col("text").alias("cell_id"))
    return tables.beside(cells, 1, 0, "below")


@query("table_claims", f"WITH {_GRID} SELECT v.table_id, s.text AS subject, h.text AS relation, v.text AS value FROM c v JOIN c h ON h.table_id = v.table_id AND h.c = v.c AND h.r = 0 JOIN c s ON s.table_id = v.table_id AND s.r = v.r AND s.c = 0 WHERE v.r > 0 AND v.c > 0")
def table_claims(spark, d):
    return tables.claims(order_grid(spark, d))


@query("pipe_tables", f"WITH {_GRID}, l AS (SELECT table_id, r, '| ' || array_to_string(t, ' | ') || ' |' AS line FROM g) SELECT table_id, string_agg(line, chr(10) ORDER BY r) AS text FROM l GROUP BY table_id")
def pipe_tables(spark, d):
    return tables.pipe_table(order_grid(spark, d))


@query("names_in_text")
def names_in_text(spark, d):
    """Names with a title before them, found wherever they stand."""
    h = head(spark, d)
    names = h.where("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:Dr|Prof|Ms|Insp|Mme|Sr|Dra)\.? ([A-Z]\p{L}+)"), 1)).alias("name")).distinct()
    return gazetteer.find_names(h.select("block_id", "text"), names)


@query("session_emissions", "WITH e AS (SELECT event_id, user_id, ts, json_extract_string(props, '$.k') AS k FROM events), p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS before FROM e) SELECT event_id, coalesce(ts - before < INTERVAL 1 HOUR, false) AS withheld FROM p")
def session_emissions(spark, d):
    """Whether the same thing was sent to the same session within the hour before."""
    w = Window.partitionBy("user_id", "k").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").alias("k"))
    return e.select("event_id", F.coalesce(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL '1' HOUR"), F.lit(False)).alias("withheld"))
