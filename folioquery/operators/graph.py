"""Graph operators: descents, bounded expansion, connected components, ordered closure, communities, salience, label resolution."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..session import cut


def descend(edges: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(root, node, depth): all descendants along (parent, child) edges, each at its least depth; cycles end by themselves.

    Nothing is left out: a tree deeper than max_depth is an error.
    """
    found = front = cut(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")))
    for depth in range(1, max_depth + 1):
        step = front.join(edges.select(F.col("parent").alias("node"), "child"), "node").select("root", F.col("child").alias("node")).distinct()
        front = cut(step.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            return found
        found = found.unionByName(front)
    raise RuntimeError("descend did not end")


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, beam: int = 64, hub_cap: int = 4096) -> DataFrame:
    """(query_id, node, hop, score): bounded traversal; per hop each query keeps its best `beam` new nodes (the feature of a beam),
    nodes with more than hub_cap neighbours are not passed through."""
    degree = edges.groupBy("a").agg(F.count("*").alias("degree"))
    open_ = edges.join(degree.where(F.col("degree") <= hub_cap).select("a"), "a", "left_semi").select("a", "b", "weight")
    found = front = cut(seeds.select("query_id", "node", F.lit(0).alias("hop"), F.col("score").cast("double").alias("score")))
    for hop in range(1, hops + 1):
        reached = front.join(open_, F.col("node") == F.col("a")).groupBy("query_id", F.col("b").alias("node")).agg(F.max(F.col("score") * F.col("weight")).alias("score"))
        new = reached.join(found.select("query_id", "node"), ["query_id", "node"], "left_anti")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
        front = cut(new.withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam).select("query_id", "node", F.lit(hop).alias("hop"), "score"))
        found = found.unionByName(front)
    return found


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the least node of each connected component, by alternating large-star and small-star rounds.

    Edges, not groups, are what moves: a hub's edges are pre-aggregated by a minimum per node, so that no task gathers a component.
    """
    current = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        fresh = cut(small)
        same = fresh.count() == current.count() and not fresh.join(current, ["u", "v"], "left_anti").limit(1).count()
        current = fresh
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def closure(pairs: DataFrame, vetoes: DataFrame) -> DataFrame:
    """(node, survivor): unions in descending score order, except those that would join the two ends of a veto.

    Components without a veto are their connected component. Only those that hold one are settled in order, one component a group.
    pairs (a, b, score), vetoes (a, b).
    """
    comp = cut(components(pairs))
    ends = vetoes.join(comp.select(F.col("node").alias("a"), "component"), "a").join(comp.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").where("component = other")
    touched = ends.select("component").distinct()
    plain = comp.join(touched, "component", "left_anti").select("node", F.col("component").alias("survivor"))
    inside = pairs.join(comp.select(F.col("node").alias("a"), "component"), "a").join(touched, "component", "left_semi").select("component", "a", "b", "score", F.lit(False).alias("veto"))
    held = inside.unionByName(ends.select("component", "a", "b", F.lit(0.0).alias("score"), F.lit(True).alias("veto")))
    kind = dict(pairs.dtypes)["a"]

    def settle(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parent = {n: n for r in rows for n in (r["a"], r["b"])}

        def top(n):
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        split = [(r["a"], r["b"]) for r in rows if r["veto"]]
        for r in sorted((r for r in rows if not r["veto"]), key=lambda r: (-r["score"], r["a"], r["b"])):
            x, y = top(r["a"]), top(r["b"])
            if x != y and not any({top(a), top(b)} == {x, y} for a, b in split):
                parent[max(x, y)] = min(x, y)
        return pa.table({"node": pa.array(list(parent), table.schema.field("a").type), "survivor": pa.array([top(n) for n in parent], table.schema.field("a").type)})

    return plain.unionByName(held.groupBy("component").applyInArrow(settle, f"node {kind}, survivor {kind}"))


def communities(memberships: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, community): label propagation over the bipartite graph of memberships (node, key), until nothing changes.

    In turn each key takes the label most of its nodes have, and each node the label most of its keys have; ties go to the least. No turn
    lowers the number of memberships whose two ends agree, and at the same number labels only fall, so the rounds end by themselves.
    Pairs of nodes are never formed: a round moves one row a membership.
    """
    member = cut(memberships.select("node", "key").distinct())
    labels = cut(member.select("node", F.col("node").alias("community")).distinct())

    def vote(rows: DataFrame, of: str) -> DataFrame:
        heaviest = F.max_by("community", F.struct("w", (-F.col("community")).alias("low")))
        return rows.groupBy(of, "community").agg(F.count("*").alias("w")).groupBy(of).agg(heaviest.alias("community"))

    for _ in range(max_rounds):
        fresh = cut(vote(member.join(vote(member.join(labels, "node"), "key"), "key"), "node"))
        same = not fresh.join(labels, ["node", "community"], "left_anti").limit(1).count()
        labels = fresh
        if same:
            return labels
    raise RuntimeError("communities did not settle")


def cohesion(memberships: DataFrame, members: DataFrame) -> DataFrame:
    """(community, members, internal, cohesion): pairs of nodes inside a community that share a key, each once, over all its pairs.

    Nodes of the same keys are one class: all its pairs are linked, and classes that share a key are linked by the product of their sizes.
    Rows grow with the different sets of keys in a community, not with its nodes.
    """
    size = members.groupBy("community").agg(F.count("*").alias("members"))
    keyed = memberships.select("node", "key").distinct().groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    classes = cut(keyed.join(members, "node").groupBy("community", "keys").agg(F.min("node").alias("class"), F.count("*").alias("m")))
    own = classes.select("community", F.expr("m * (m - 1) div 2").alias("links"))
    by_key = classes.select("community", "class", "m", F.explode("keys").alias("key"))
    other = by_key.select("community", "key", F.col("class").alias("other"), F.col("m").alias("k"))
    met = by_key.join(other, ["community", "key"]).where("class < other").select("community", "class", "other", (F.col("m") * F.col("k")).alias("links")).distinct()
    inner = own.unionByName(met.select("community", "links")).groupBy("community").agg(F.sum("links").alias("internal"))
    n = F.col("members")
    return size.join(inner, "community", "left").na.fill(0, ["internal"]).select("community", "members", "internal", F.try_divide(F.col("internal") * 2.0, n * (n - 1)).alias("cohesion"))


def salience(edges: DataFrame) -> DataFrame:
    """(node, degree): the number of distinct other nodes beside each."""
    pairs = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    return pairs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


#: Fixed values of label resolution.
PERMUTATIONS, BANDS, ROWS = 128, 32, 4
MERGE_AT, AMBIGUOUS_AT, MIN_ENTROPY = 92.0, 75.0, 2.5


#: Rows of a bucket that one task meets with one another; larger buckets are met in pairs of sub-blocks.
SUB_BLOCK = 256


def numbers(c: Column) -> Column:
    """The numbers in a label, in order of text, with repeats."""
    return F.sort_array(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1))


def label_candidates(labels: DataFrame, same_numbers: bool = False) -> DataFrame:
    """(a, b) with a < b: all pairs of labels (id, label) that share a MinHash band of their character shingles.

    Copies of a label are one candidate, so a label that a third of the rows bear costs one row. A bucket is salted into sub-blocks, and each
    pair of sub-blocks is a key of its own, so no task meets a whole bucket. With same_numbers, labels of other numbers are not met: these
    are the pairs that numbers_differ() blocks, and the only ones left out.
    """
    one = labels.groupBy("label").agg(F.min("id").alias("id"))
    keyed = one.withColumn("s", text.shingles(F.col("label"))).where(F.size("s") > 0).withColumn("n", numbers(F.col("label")) if same_numbers else F.array().cast("array<string>"))
    banded = keyed.select("id", "n", F.explode(similarity.band_keys(similarity.minhash(F.col("s"), PERMUTATIONS), BANDS, ROWS)).alias("k")).select("id", F.xxhash64("k.band", "k.bucket", "n").alias("bucket"))
    banded = cut(banded)
    size = banded.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1").select("bucket", F.ceil(F.col("rows") / SUB_BLOCK).cast("int").alias("blocks"))
    placed = banded.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = placed.select("bucket", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("id").alias("x"))
    right = placed.select("bucket", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("id").alias("y"))
    met = left.join(right, ["bucket", "i", "j"]).where("i < j AND x <> y OR x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def numbers_differ(a, b):
    """Guard: the numbers in two labels are not the same."""
    return numbers(a) != numbers(b)


def prefix_contained(a, b):
    """Guard: one label is a proper prefix of the other at a word's end."""
    return F.startswith(a, F.concat(b, F.lit(" "))) | F.startswith(b, F.concat(a, F.lit(" ")))


def tokens_swapped(a, b):
    """Guard: the same words in another order."""
    words = lambda c: F.split(F.lower(c), " +")
    return (F.sort_array(words(a)) == F.sort_array(words(b))) & (words(a) != words(b))


def fuzzy_pairs(labels: DataFrame, same_numbers: bool = False) -> DataFrame:
    """(a, b, score, decision): candidates scored by Jaro-Winkler; merge from 92, ambiguous from 75, blocked by a guard, else apart.

    With same_numbers, pairs blocked for their numbers are not listed; merges and ambiguous pairs are the same.
    """
    named = labels.groupBy("label").agg(F.min("id").alias("id")).where(text.entropy(F.col("label")) >= MIN_ENTROPY)
    pairs = label_candidates(named, same_numbers).join(named.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(named.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    scored = pairs.withColumn("score", similarity.jaro_winkler_score(F.col("la"), F.col("lb")))
    a, b = F.col("la"), F.col("lb")
    guard = numbers_differ(a, b) | prefix_contained(a, b) | tokens_swapped(a, b)
    return scored.select("a", "b", "score", F.when(guard, "blocked").when(F.col("score") >= MERGE_AT, "merge").when(F.col("score") >= AMBIGUOUS_AT, "ambiguous").otherwise("apart").alias("decision"))
