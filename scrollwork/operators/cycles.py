"""Which nodes of directed graphs lie on a common cycle (strongly connected components).

Graphs of many documents are worked on together; ``edges(doc_id, a, b)`` may hold one very large graph. Two steps take turns until no
edge is left:

* *Shortening.* Nodes without a way in or out are dropped. A node with one way in and one way out is replaced by an edge between its
  neighbours and remembered; of neighbouring ones the one with the larger hash goes. A chain or tree loses a fixed share of its
  nodes with every round, so rounds grow with the logarithm of its length.
* *Colouring*, on what has neither ends nor chains. Every node takes the largest name from which it can be reached; the nodes of a
  colour that reach the node of that name are one component. Rounds grow with the longest shortest way in the shortened graph.

Remembered nodes are put back in reverse order: one belongs to a component if both its neighbours do. Every round is keyed by
``(doc_id, node)``, so one large document is spread, and no list or closure of a graph is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scrollwork.session import cut_lineage

NODE = ["doc_id", "node"]


def _touching(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(nodes.select("doc_id", F.col("node").alias(end)), ["doc_id", end], how)
    return edges.select("doc_id", "a", "b")


def _ways(edges: DataFrame) -> DataFrame:
    """``doc_id, node, ins, outs, prv, nxt``: how many ways lead in and out, and one of each."""
    sides = edges.select("doc_id", F.col("b").alias("node"), F.col("a").alias("prv"), F.lit(None).cast(dict(edges.dtypes)["b"]).alias("nxt")).unionByName(
        edges.select("doc_id", F.col("a").alias("node"), F.lit(None).cast(dict(edges.dtypes)["a"]).alias("prv"), F.col("b").alias("nxt"))
    )
    return sides.groupBy(*NODE).agg(F.count("prv").alias("ins"), F.count("nxt").alias("outs"), F.min("prv").alias("prv"), F.min("nxt").alias("nxt"))


def _shortened(edges: DataFrame, turn: int):
    """Edges after dropping ends and shortening chains, the chain nodes taken out in each round, and nodes found on a cycle of their own."""
    taken, loops = [], []
    while True:
        turn += 1
        draw = lambda c: F.xxhash64(c, F.lit(turn))
        ways = _ways(edges)
        dead = (F.col("ins") == 0) | (F.col("outs") == 0)
        chain = (F.col("ins") == 1) & (F.col("outs") == 1) & (draw("node") > draw("prv")) & (draw("node") > draw("nxt"))
        gone = cut_lineage(ways.filter(dead | chain).select(*NODE, "prv", "nxt", chain.alias("chain")))
        if gone.isEmpty():
            return edges, taken, loops, turn
        out = gone.filter("chain").drop("chain")
        bridges = out.select("doc_id", F.col("prv").alias("a"), F.col("nxt").alias("b"))
        taken.append(out)
        loops.append(bridges.filter("a = b").select("doc_id", F.col("a").alias("node")))
        edges = cut_lineage(_touching(edges, gone, "left_anti").unionByName(bridges.filter("a <> b")).distinct())


def _coloured(edges: DataFrame) -> DataFrame:
    """``doc_id, node, colour``: the largest node from which the node can be reached."""
    start = edges.select("doc_id", F.col("a").alias("node")).union(edges.select("doc_id", F.col("b").alias("node"))).distinct()
    colours = cut_lineage(start.withColumn("colour", F.col("node")).withColumn("new", F.lit(True)))
    while not colours.filter("new").isEmpty():
        # only nodes whose colour has changed tell their successors
        told = edges.join(colours.filter("new").withColumnRenamed("node", "a"), ["doc_id", "a"]).select("doc_id", F.col("b").alias("node"), "colour")
        best = told.groupBy(*NODE).agg(F.max("colour").alias("told"))
        rise = F.coalesce(F.col("told") > F.col("colour"), F.lit(False))
        colours = cut_lineage(
            colours.drop("new").join(best, NODE, "left").select(*NODE, F.when(rise, F.col("told")).otherwise(F.col("colour")).alias("colour"), rise.alias("new"))
        )
    return colours.drop("new")


def _components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of one component per colour, and the edges that may still lie on other cycles."""
    colours = _coloured(edges)
    tail = colours.select("doc_id", F.col("node").alias("a"), F.col("colour").alias("ca"))
    head = colours.select("doc_id", F.col("node").alias("b"), F.col("colour").alias("cb"))
    same = cut_lineage(edges.join(tail, ["doc_id", "a"]).join(head, ["doc_id", "b"]).filter("ca = cb").select("doc_id", "a", "b", F.col("ca").alias("colour")))
    found = front = cut_lineage(colours.filter("node = colour"))
    while not front.isEmpty():
        back = same.join(front.select("doc_id", F.col("node").alias("b")), ["doc_id", "b"]).select("doc_id", F.col("a").alias("node"), "colour").distinct()
        front = cut_lineage(back.join(found, NODE, "left_anti"))
        found = cut_lineage(found.unionByName(front))
    return found, cut_lineage(_touching(same, found, "left_anti"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """``doc_id, node, component``: every node that lies on a cycle, with the least node that shares a cycle with it.

    An edge from a node to itself is a cycle of one node. Rows with a null in any column are left out, repeated rows count once,
    other columns are ignored. A graph without edges gives no rows.
    """
    given = edges.select("doc_id", "a", "b").dropna().distinct()
    left = cut_lineage(given.filter("a <> b"))
    loops = [given.filter("a = b").select("doc_id", F.col("a").alias("node"))]
    known = loops[0].filter(F.lit(False)).withColumn("component", F.col("node"))
    taken, turn = [], 0
    while not left.isEmpty():
        left, out, own, turn = _shortened(left, turn)
        taken += out
        loops += own
        if not left.isEmpty():
            found, left = _components(left)
            # a colour alone on its node is no cycle; the node counts if it was shortened to one
            size = found.groupBy("doc_id", "colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
            known = known.unionByName(found.join(size, ["doc_id", "colour"], "left_semi").select(*NODE, F.col("colour").alias("component")))
    own = loops[0]
    for more in loops[1:]:
        own = own.unionByName(more)
    own = cut_lineage(own.distinct())
    known = cut_lineage(known.unionByName(own.join(known, NODE, "left_anti").withColumn("component", F.col("node"))))
    for out in reversed(taken):
        near = lambda end: known.select("doc_id", F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        back = out.join(near("prv"), ["doc_id", "prv"]).join(near("nxt"), ["doc_id", "nxt"]).filter("c_prv = c_nxt").select(*NODE, F.col("c_prv").alias("component"))
        # nothing put back so far was named after a node of this round, so one with a cycle of its own just joins the larger one
        back = cut_lineage(back)
        known = cut_lineage(known.join(back, NODE, "left_anti").unionByName(back))
    least = known.groupBy("doc_id", "component").agg(F.min("node").alias("least"))
    return known.join(least, ["doc_id", "component"]).select(*NODE, F.col("least").alias("component"))
