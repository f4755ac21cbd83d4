"""Graph algorithms over edges (src, dst) as loops of joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.recursion import Met, iterate, rounds
from tidemark.session import discard, materialize


def bfs(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, dist): fewest edges from any root; unreachable nodes are left out."""
    e = materialize(edges.select("src", "dst").dropna().distinct(), "edges")
    met = Met(e.sparkSession, ["node"])
    new = roots.toDF("node").dropna()
    for d in rounds(max_rounds):
        frontier = met.add(new.withColumn("dist", F.lit(d)))
        if not frontier.take(1):
            return met.rows()
        new = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node"))


def bidijkstra(edges: DataFrame, goals: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(src, dst, dist) of each goal pair: two searches meet in the middle; unreachable pairs are left out.

    A pair leaves both searches in the round its distance is certain.
    """
    e = materialize(edges.select("src", "dst").dropna().distinct(), "edges")
    left = materialize(goals.toDF("src", "dst").dropna().distinct(), "goals")
    near = left.select("src", "dst", F.col("src").alias("node"), F.lit(0).alias("dist"))
    far = left.select("src", "dst", F.col("dst").alias("node"), F.lit(0).alias("dist"))
    sides = {"f": [near, near], "b": [far, far]}  # all reached, frontier
    found = left.filter("src = dst").withColumn("dist", F.lit(0))
    left = left.filter("src <> dst")
    for d in rounds(max_rounds):
        d += 1
        side = "f" if d % 2 else "b"
        a, b = ("src", "dst") if side == "f" else ("dst", "src")
        hop = e.select(F.col(a).alias("node"), F.col(b).alias("to"))
        reached, frontier = sides[side]
        new = frontier.join(left, ["src", "dst"], "left_semi").join(hop, "node").select("src", "dst", F.col("to").alias("node")).distinct()
        steps = (d + 1) // 2 if side == "f" else d // 2
        new = materialize(new.join(reached, ["src", "dst", "node"], "left_anti").withColumn("dist", F.lit(steps)), "bidi")
        sides[side] = [reached.union(new), new]
        f, g = sides["f"][0], sides["b"][0].withColumnRenamed("dist", "rest")
        met = f.join(g, ["src", "dst", "node"]).join(left, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min(F.col("dist") + F.col("rest")).alias("dist"))
        met = materialize(met, "met")
        found, left = found.union(met), materialize(left.join(met, ["src", "dst"], "left_anti"), "left")
        if not left.take(1) or not (sides["f"][1].take(1) and sides["b"][1].take(1)):
            return found


def propagate(edges: DataFrame, labels: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, label): the least label from which the node can be reached along edges."""
    e = materialize(edges.select("src", "dst").dropna().distinct(), "edges")
    now = materialize(labels.toDF("node", "label").groupBy("node").agg(F.min("label").alias("label")), "labels")
    changed = now
    for _ in rounds(max_rounds):
        sent = changed.join(e, changed["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        nxt = now.join(sent, "node", "full").select("node", "label", F.least("label", "new").alias("best"))
        nxt = materialize(nxt, "labels")
        changed = nxt.filter("label IS NULL OR best < label").select("node", F.col("best").alias("label"))
        discard(now)
        now = nxt.select("node", F.col("best").alias("label"))
        if not changed.take(1):
            return now


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component) of the undirected graph; the component is its least node.

    Large and small stars in turn: every node links to the least of its neighbourhood, which halves
    distances, so the rounds grow with the logarithm of the diameter.
    """
    pairs = edges.select("src", "dst").dropna()
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    e = materialize(pairs.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    for _ in rounds(max_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = materialize(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        if not small.exceptAll(e).take(1) and not e.exceptAll(small).take(1):
            return nodes.join(small.groupBy("u").agg(F.min("v").alias("c")), nodes["node"] == F.col("u"), "left").select(
                "node", F.coalesce("c", "node").alias("component")
            )
        e = small


def trim(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Edges that can lie on a cycle: those whose source has an incoming edge, again and again."""
    return iterate(
        edges.select("src", "dst").dropna().distinct(),
        lambda e: e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), max_rounds,
    )


def strongly_connected(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component) of nodes on cycles: the component is its least node.

    Labels are propagated forward and backward; an edge whose ends disagree in either lies in no
    component, and the rest is done again.
    """
    e = trim(edges)
    for _ in rounds(max_rounds):
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        own = nodes.select("node", F.col("node").alias("label"))
        forward, backward = propagate(e, own), propagate(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), own)
        both = materialize(forward.join(backward.withColumnRenamed("label", "back"), "node"), "scc")
        s = both.select(F.col("node").alias("src"), F.col("label").alias("sl"), F.col("back").alias("sb"))
        d = both.select(F.col("node").alias("dst"), F.col("label").alias("dl"), F.col("back").alias("db"))
        kept = trim(e.join(s, "src").join(d, "dst").filter("sl = dl AND sb = db").select("src", "dst"))
        if kept.count() == e.count():
            return both.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("node", F.col("label").alias("component"))
        e = kept


def sequence(edges: DataFrame, start: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, value) of an ordered greedy: nodes in turn take the least number that no smaller
    neighbour has (a colouring; loops don't count).  A node is decided once all its smaller neighbours are."""
    known = edges.select("src", "dst").dropna()
    pairs = known.filter("src <> dst")
    lower = materialize(pairs.select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("before")).distinct(), "seq")
    nodes = materialize(start.toDF("node").dropna().union(known.select("src")).union(known.select("dst")).distinct(), "seq-nodes")
    done = None
    for _ in rounds(max_rounds):
        todo = nodes if done is None else nodes.join(done, "node", "left_anti")
        if not todo.take(1):
            return nodes.withColumn("value", F.lit(0)) if done is None else done
        known = lower.join(todo, "node", "left_semi")
        if done is None:
            ready = todo.join(known, "node", "left_anti").withColumn("value", F.lit(0))
        else:
            d = done.select(F.col("node").alias("before"), "value")
            used = known.join(d, "before", "left").groupBy("node").agg(
                F.collect_set("value").alias("used"), F.count(F.when(F.col("value").isNull(), 1)).alias("open"), F.count(F.lit(1)).alias("n")
            ).filter("open = 0")
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
            ready = used.select("node", free.alias("value"))
        ready = materialize(ready, "seq-ready")
        done = ready if done is None else done.union(ready)


def k_core(edges: DataFrame, k: int, max_rounds: int | None = None) -> DataFrame:
    """Edges of the largest undirected subgraph in which every node has at least k neighbours."""
    e = edges.select("src", "dst").dropna().filter("src <> dst")
    e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def prune(e: DataFrame) -> DataFrame:
        degree = e.select(F.col("src").alias("n")).union(e.select("dst")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
        keep = degree.filter(F.col("d") >= k).select("n")
        return e.join(keep, e["src"] == keep["n"], "left_semi").join(keep, e["dst"] == keep["n"], "left_semi")

    return iterate(e, prune, max_rounds)


def identifiers(df: DataFrame, name: str = "id", max_rounds: int | None = None) -> DataFrame:
    """Distinct rows with a unique 64-bit number each: a digest; where digests collide, all but the
    first are hashed again with the round's number."""
    rows = df.distinct()
    cols = [F.col(f"`{c}`") for c in rows.columns]
    now = materialize(rows.withColumn(name, F.xxhash64(*cols)), "ids")
    w = Window.partitionBy(name).orderBy(*cols)
    for r in rounds(max_rounds):
        if not now.groupBy(name).count().filter("count > 1").take(1):
            return now
        again = F.xxhash64(*cols, F.lit(r + 1))
        now = materialize(now.withColumn("__r", F.row_number().over(w)).withColumn(name, F.when(F.col("__r") > 1, again).otherwise(F.col(name))).drop("__r"), "ids")
