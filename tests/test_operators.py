"""Operators against brute force and hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioquery.functions import similarity, stats, text
from folioquery.operators import derive, filters, graph, retrieval
from folioquery.plans.search import parse_query
from folioquery.session import cut, store
from folioquery.sources import readers
from folioquery.streaming import events


def test_wilson(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (10, 10), (5, 10)], "k int, n int").select(low, high).collect()
    assert tuple(got[0]) == (None, None) and math.isclose(got[1][1], 1.0) and got[1][0] < 1
    assert math.isclose(got[2][0], 0.2365931, abs_tol=1e-6)


def test_pool_adjacent():
    assert stats.pool_adjacent([(1, 3.0, 1), (2, 1.0, 1), (3, 4.0, 2)]) == [(1, 2.0), (2, 2.0), (3, 4.0)]


def test_kleene(spark):
    p = filters.predicate
    df = spark.createDataFrame([(None, 1), (None, 5), (2, 5)], "a int, b int")
    got = df.select(filters.clause(all_of=[p("a", "eq", 2), p("b", "gt", 3)])).collect()
    assert [r[0] for r in got] == [False, None, True]


def test_parse_query():
    q = parse_query('kind:heading,title page:2-4 trust:1 foo:bar "exact words" alpha')
    assert q.filters.kinds == ("heading", "title") and q.filters.pages == (2, 4) and q.filters.min_trust == 1
    assert q.phrases == ["exact words"] and q.terms == ["foo", "bar", "alpha"]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "query_id int, block_id int, score double")
    b = spark.createDataFrame([(1, 2, 2.0), (1, 3, 1.0)], "query_id int, block_id int, score double")
    out = {r.block_id: r.score for r in retrieval.fuse({"a": a, "b": b}, weights={"a": 1.0, "b": 1.0}).collect()}
    assert sorted(out, key=lambda k: -out[k]) == [2, 1, 3] and math.isclose(out[1], 1 / 61) and math.isclose(out[3], 1 / 62)


def test_ceiling(spark):
    s = spark.createDataFrame([(1, "a", "OK", None), (1, "b", "EMPTY", None), (1, "c", "OFF", "not_in_plan")], "query_id int, channel string, status string, reason string")
    assert math.isclose(retrieval.ceiling(s, {"a": 1.0, "b": 1.0, "c": 1.0}).first().ceiling, 2 / 61)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 600)]
    parent = {n: n for p in pairs for n in p}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {n: top(n) for n in parent}


def test_closure_keeps_vetoes(spark):
    pairs = spark.createDataFrame([(1, 2, 99.0), (2, 3, 95.0), (7, 8, 93.0)], "a bigint, b bigint, score double")
    vetoes = spark.createDataFrame([(1, 3)], "a bigint, b bigint")
    got = {r.node: r.survivor for r in graph.closure(pairs, vetoes).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 7: 7, 8: 7}


def test_segmenter_closes(spark):
    rows = [(1, "body", "paragraph", 0, i, i, "x" * 2400) for i in range(5)] + [(1, "body", "heading", 0, 9, 9, "h"), (1, "body", "paragraph", 0, 10, 10, "y" * 9000)]
    df = spark.createDataFrame(rows, "doc_ord bigint, layer string, kind string, page int, ord int, block_id bigint, text string")
    got = {r.block_id: r.seq for r in derive.segments(df).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 9: 3, 10: 4}


def test_money_rounds_half_even(spark):
    got = spark.range(1).select(derive.money([F.lit(1), F.lit(1)], ["0.5", "2"]), derive.money([F.lit(1), F.lit(1)], ["0.5", "1"])).first()
    assert tuple(got) == (2, 2)


def test_allocation():
    out = derive.allocate([{"doc": i, "weight": w, "demand": 9000, "blocks": 2} for i, w in ((1, 3.0), (2, 1.0))], 12000)
    assert [o["doc"] for o in out] == [1, 2] and out[0]["chars"] > out[1]["chars"] and sum(o["chars"] for o in out) < 12000


@pytest.mark.parametrize(("a", "b", "want"), [("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("", "a", 0.0), ("a", "a", 1.0)])
def test_jaro_winkler(a, b, want):
    assert round(similarity.jaro_winkler(a, b), 4) == want


def test_fuzzy():
    assert similarity.edit_distance("kitten", "sitting") == 3
    assert (6, 1) in similarity.fuzzy_ends("abcd", "xxabxd", 1)


def test_text_functions(spark):
    df = spark.createDataFrame([("Ｆｏｏ  Bar!",), ("x_y",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize_key(F.col("t"))).collect()] == ["foo_bar", "x_y", "", None]
    assert text.fold_view("A­—B  “c”")[0] == 'a-b "c"'


def test_readers():
    assert readers.read_markdown("# T\n\np1\np2\n\n- a\n```\ncode\n```\n| x | y |\n|---|---|")[:3] == [("heading", 1, "T"), ("paragraph", None, "p1\np2"), ("list_item", 1, "a")]
    assert readers.read_html("<h2>A &amp; B</h2><p>x<br>y</p><script>no</script><ul><li>i</li></ul>") == [("heading", 2, "A & B"), ("paragraph", None, "x y"), ("list_item", 1, "i")]
    assert readers.read_json('{"a": {"b": [1, 2]}}') == [("paragraph", None, "a.b[0]: 1"), ("paragraph", None, "a.b[1]: 2")]
    assert readers.decode(b"\xef\xbb\xbfh\x01i") == ("hi", "utf-8") and readers.decode(b"\xe9")[1] == "latin-1"


def test_unreadable_documents_stay(spark):
    df = spark.createDataFrame([(1, "json", "{"), (2, "txt", None), (3, "txt", "a\n\nb")], "id bigint, f string, t string")
    got = [(r.id, r.kind) for r in readers.read_blocks(df, "id", "f", "t").orderBy("id", "ord").collect()]
    assert got == [(1, "unreadable"), (3, "paragraph"), (3, "paragraph")]


def test_event_log_sets_torn_lines_aside(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"event_id": 1, "event_type": "x"}\n{"event_id": 2, "ev')
    good, torn = events.read_log(spark, str(tmp_path))
    assert [r.event_id for r in good.collect()] == [1] and torn.count() == 1


def test_cut_and_store(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert cut(df).count() == 10 and store(df).select("x").agg(F.sum("x")).first()[0] == 90


def test_gazetteer_takes_the_leftmost_longest(spark):
    blocks = spark.createDataFrame([(1, "Brenlow Ltd. of Eastmere met Brenlow; nobody met Ltd of."), (2, None), (3, "")], "block_id bigint, text string")
    names = spark.createDataFrame([("Brenlow",), ("Brenlow Ltd",), ("Ltd of Eastmere",), ("Eastmere",), ("nobody",)], "name string")
    from folioquery.operators import gazetteer

    got = [(r["at"], r.name) for r in gazetteer.find_names(blocks, names).orderBy("at").collect()]
    assert got == [(0, "Brenlow Ltd"), (3, "Eastmere"), (5, "Brenlow"), (6, "nobody")]


def test_grid_slots(spark):
    from folioquery.operators import tables

    cells = spark.createDataFrame([(1, "a", 0, 0, 1, 2), (1, "b", 1, 0, 2, 1), (1, "c", 1, 1, None, 0), (1, "x", 0, 1, 1, 1)], "table_id int, cell_id string, r int, c int, row_span int, col_span int")
    got = {(r["r"], r["c"]): r.cell_id for r in tables.slots(cells).collect()}
    assert got == {(0, 0): "a", (0, 1): "a", (1, 0): "b", (2, 0): "b", (1, 1): "c"}


def test_signatures(spark):
    df = spark.createDataFrame([([1.0, -2.0, 0.5], [1.0, 2.0, -0.5])], "a array<double>, b array<double>")
    row = df.select(similarity.hamming(similarity.signature(F.col("a")), similarity.signature(F.col("b"))).alias("h"), similarity.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row.h == 2 and math.isclose(row.c, (1 - 4 - 0.25) / 5.25)


def test_label_pairs_against_all_pairs_of_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(graph, "SUB_BLOCK", 5)
    names = [f"{i}. {t}{v}" for i in range(1, 9) for t in ("Delivery conditions of the archive", "Delivery condition of the archives") for v in ("", ", annex", " (copy)")]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, label string")
    keyed = df.select("id", F.explode(similarity.band_keys(similarity.minhash(text.shingles(F.col("label")), graph.PERMUTATIONS), graph.BANDS, graph.ROWS)).alias("k")).select("id", "k.*").collect()
    buckets: dict[tuple, set] = {}
    for r in keyed:
        buckets.setdefault((r.band, r.bucket), set()).add(r.id)
    want = {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}
    got = {(r.a, r.b): r.decision for r in graph.fuzzy_pairs(df).collect()}
    assert set(got) == want and sum(d == "merge" for d in got.values()) > 8
    assert {(r.a, r.b): r.decision for r in graph.fuzzy_pairs(df, same_numbers=True).collect() if r.decision != "blocked"} == {p: d for p, d in got.items() if d != "blocked"}


def test_documents_of_one_heading_are_one_community(spark):
    rows = [(i, "a") for i in range(40)] + [(i, k) for i in range(100, 130) for k in ("b", "c")] + [(i, "d") for i in range(200, 203)] + [(i, "e") for i in range(201, 204)] + [(202, "f"), (203, "f")]
    member = spark.createDataFrame(rows, "node bigint, key string")
    found = graph.communities(member)
    got = {r.node: r.community for r in found.collect()}
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(100, 130)} == {100}
    keys: dict[int, set] = {}
    for n, k in rows:
        keys.setdefault(n, set()).add(k)
    for r in graph.cohesion(member, found).collect():
        nodes = [n for n in got if got[n] == r.community]
        internal = sum(bool(keys[a] & keys[b]) for a in nodes for b in nodes if a < b)
        assert (r.members, r.internal) == (len(nodes), internal) and (len(nodes) < 2 or math.isclose(r.cohesion, internal * 2 / len(nodes) / (len(nodes) - 1)))


def test_quotations_are_sought_in_every_block(spark, tmp_path):
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(n))) for n in (80, 120))
        assert similarity.fuzzy_least(a, b) == (0 if a in b else min(d for _, d in similarity.fuzzy_ends(a, b, len(a))))
    from folioquery.plans import derive as plans

    blocks = [(1, 0, "the ledger of the archive is kept", 1), (1, 0, "is kept the archive of the ledger " + "x" * 9, 2), (1, 1, "y" * 5000 + "long quotation", 3), (1, 1, "long", 4)]
    asked = [("a1", 0, "the ledger of the archive is kept"), ("a2", 1, "long quotation"), ("a3", 1, "long quotatoin y")]
    spark.createDataFrame([(1, 0, "u", "ok")], "doc_ord bigint, gen int, uri string, status string").write.parquet(f"{tmp_path}/doc.parquet")
    spark.createDataFrame([(d, p, t, i, 0, 0, None) for d, p, t, i in blocks], "doc_ord bigint, page int, text string, block_id bigint, gen int, state int, written_at timestamp").write.parquet(f"{tmp_path}/block.parquet")
    spark.createDataFrame([(i, "u", p, "present", 2, '{"text": "%s"}' % q) for i, p, q in asked], "assertion_id string, doc string, page int, type string, max_diffs int, spec string").write.parquet(f"{tmp_path}/eval_assertion.parquet")
    got = {r.assertion_id: (r.diffs, r.passed) for r in plans.assertion_diffs(spark, str(tmp_path)).collect()}
    assert got == {"a1": (0, True), "a2": (0, True), "a3": (4, False)}


def test_thresholds_are_fitted_over_unrounded_scores(spark, tmp_path):
    from folioquery.plans import reports

    rows = [("r", f"a{i}", "text", passed, score, "s", 1, 1) for i, (score, passed) in enumerate([(0.86, 0), (0.861, 0), (0.94, 1), (0.94, 1), (None, 1)])]
    spark.createDataFrame(rows, "run_id string, assertion_id string, evaluator string, passed int, score double, slice_key string, wall_ms int, micros int").withColumn("loaded_at", F.lit("2026-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/eval_verdict.parquet")
    got = [(r.score, r.n, r.fitted) for r in reports.threshold_fit(spark, str(tmp_path)).orderBy("score").collect()]
    assert got == [(0.86, 1, 0.0), (0.861, 1, 0.0), (0.94, 2, 1.0)]


def test_descend_reaches_every_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(19)], "parent bigint, child bigint")
    got = {r.node: r.depth for r in graph.descend(edges, spark.createDataFrame([(0,)], "root bigint")).collect()}
    assert got == {i: i for i in range(20)}
    with pytest.raises(RuntimeError):
        graph.descend(edges, spark.createDataFrame([(0,)], "root bigint"), 3)


def test_spans_of_files_in_any_order_of_time(spark, tmp_path):
    import datetime
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    from folioquery.plans import files

    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(30):
        at = datetime.datetime(2026, 3, 1) - datetime.timedelta(days=i)
        rows = {"event_id": [2 * i, 2 * i + 1], "user_id": [i, i], "event_type": ["view", "purchase"], "ts": pa.array([at, at + datetime.timedelta(minutes=30)], pa.timestamp("us"))}
        pq.write_table(pa.table(rows), folder / f"{i:02}.parquet")
        os.utime(folder / f"{i:02}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    assert sorted(r.user_id for r in files.span_pairs(spark, str(tmp_path)).collect()) == list(range(30))


def test_sign_flip_bands():
    from itertools import product

    from folioquery.functions.stats import sign_flip_p

    d = [0.5, -0.25, 0.75, 1.0, -0.5]
    brute = [abs(sum(s * x for s, x in zip(signs, d))) for signs in product((1, -1), repeat=len(d))]
    assert sign_flip_p(d, "x") == sum(b >= abs(sum(d)) - 1e-12 for b in brute) / len(brute)
    assert sign_flip_p([], "x") is None and sign_flip_p([0.0] * 300, "x") == 1.0
    assert sign_flip_p([1.0] * 50, "x") == 1 / 10_000 and sign_flip_p([1.0, -1.0] * 25, "x") == 1.0
    assert sign_flip_p([1.0] * 300, "x") < 1e-12


def test_names_of_any_length(spark):
    from folioquery.operators.gazetteer import find_names

    blocks = spark.createDataFrame([(1, "the Board for Long Term Storage of Paper Records met"), (2, "Board for Long Term Plans"), (3, None)], "block_id int, text string")
    names = spark.createDataFrame([("Board for Long Term Storage of Paper Records",), ("Board",), (None,), ("",)], "name string")
    assert sorted((r.block_id, r.name, r.words) for r in find_names(blocks, names).collect()) == [(1, "Board for Long Term Storage of Paper Records", 8), (2, "Board", 1)]


def test_signature_of_every_dimension(spark):
    a, b = [1.0] * 768, [1.0] * 700 + [-1.0] * 68
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    row = df.select(F.size(similarity.signature(F.col("a"))).alias("n"), similarity.hamming(similarity.signature(F.col("a")), similarity.signature(F.col("b"))).alias("far")).first()
    assert row.n == 12 and row.far == 68


def test_every_reference_stands(spark):
    from folioquery.operators import derive

    blocks = spark.createDataFrame([(1, 1, " ".join(f"Section {i}." for i in range(100)))], "block_id int, doc_ord int, text string")
    assert derive.references(blocks).count() == 100


def test_titles_of_any_script(spark):
    rows = [("Приложение", "Содержание", 0), ("目次", "Приложение", 0), ("ПРИЛОЖЕНИЕ", "приложение", 45), ("Table 3-2", "table 3.2", 40), ("Table 3.2 (revised)", "Table 3.2", 30), ("Table", "Table 3.2", 30), ("", "x", 0)]
    df = spark.createDataFrame(rows, "t string, w string, g int")
    assert all(r.got == r.g for r in df.select("*", text.title_grade(F.col("t"), F.col("w")).alias("got")).collect())


def test_redaction(spark):
    from folioquery.plans.records import redact

    rows = [("Authorization: Bearer abc", "Authorization: <redacted>"), ("x ghp_0123456789abcdefXYZ y", "x <redacted:token> y"), ("d" * 32, "<redacted:hex>"), ("d" * 31, "d" * 31), ("<|im_start|>", "<redacted:sentinel>"), (None, None)]
    df = spark.createDataFrame(rows, "s string, want string")
    assert all(r.got == r.want for r in df.select("want", redact(F.col("s")).alias("got")).collect())


def test_containers(spark, tmp_path):
    import gzip
    import io
    import zipfile

    from folioquery.sources import containers

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a/b.txt", "x")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("plain.txt", "y")
    (tmp_path / "bomb.gz").write_bytes(gzip.compress(b"0" * 20_000_000))
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04nothing")
    rows = {(r.member, r.fault) for r in containers.expand(spark, str(tmp_path)).collect()}
    assert rows == {("a/b.txt", None), ("plain.txt", None), ("bomb.gz", "expands beyond its limit"), ("broken.zip", "BadZipFile")}


def test_durations_and_config():
    from folioquery.sdk import Config

    assert [text.parse_duration(x) for x in ("5m", "2h", "7d")] == [300, 7200, 604800]
    with pytest.raises(ValueError):
        text.parse_duration("7w")
    base, more = Config.resolve(), Config.resolve({"fusion.k": "30"}, {"shuffle.partitions": 8})
    assert more.semantic["fusion.k"] == 30 and base.digest() != more.digest() and base.digest() == Config.resolve({"shuffle.partitions": 8}).digest()
    with pytest.raises(KeyError):
        Config.resolve({"nothing": 1})


def test_plan_and_short_circuit(spark):
    from folioquery.plans.search import parse_query

    assert retrieval.plan(parse_query("kind:heading"))[0] == ("identity", "OFF(nothing_to_ask)")
    assert dict(retrieval.plan(parse_query("see Section 4")))["exact"] == "OK"
    graded = spark.createDataFrame([(1, 50.0), (1, 10.0), (2, 45.0)], "query_id int, score double")
    assert [r.query_id for r in retrieval.short_circuit(graded).collect()] == [1]


def test_document_handle(spark, data):
    from folioquery.sdk import corpus

    doc = corpus(spark, data).doc(2)
    rows = doc.blocks(pages=(0, 1)).collect()
    assert rows and all(r.doc_ord == 2 and 0 <= r.page <= 1 for r in rows)
    assert doc.subtree(rows[0].block_id).count() >= 1
    assert doc.quote(rows[0].block_id, "no such words").first().exact in (False, None)
    assert set(corpus(spark, data).load().columns) == {"page_content", "metadata"}


def test_quads(spark):
    from folioquery.functions.geometry import ordered_quad

    corners = [(0.1, 0.2), (0.9, 0.2), (0.9, 0.8), (0.1, 0.8)]
    rng = random.Random(4)
    rows = [([x for p in rng.sample(corners, 4) for x in p],) for _ in range(12)] + [([1.0],), (None,)]
    got = [r.q for r in spark.createDataFrame(rows, "p array<double>").select(ordered_quad(F.col("p")).alias("q")).collect()]
    assert all([tuple(p) for p in q] == [(100, 200), (900, 200), (900, 800), (100, 800)] for q in got[:12]) and got[12:] == [None, None]


def test_nearest_ranks(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([None, *range(9)])) for k in "aab" for _ in range(101)]
    got = {r.k: (r.p50, r.p95) for r in stats.nearest_ranks(spark.createDataFrame(rows, "k string, x int"), "k", "x", {"p50": 0.5, "p95": 0.95}).collect()}
    for k in "ab":
        v = sorted(x for j, x in rows if j == k and x is not None)
        assert got[k] == (v[math.ceil(0.5 * len(v)) - 1], v[math.ceil(0.95 * len(v)) - 1])


def test_command_line(capsys):
    from folioquery.__main__ import main

    assert main(["list"]) == 0 and "fused_search" in capsys.readouterr().out
    assert main(["sql", "budget_tier"]) == 0 and "SELECT" in capsys.readouterr().out
