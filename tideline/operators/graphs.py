"""Trees and forests as tables: pointer doubling, and minimum spanning forests by contraction (Borůvka).

Every step is a join or a combined aggregation on narrow rows, written to the shared folder; nothing of a graph is gathered.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read again.

    Not a checkpoint: that takes the estimated size of its plan along, a product over all joins of all rounds, until planning takes minutes
    and nothing is ever small enough to broadcast. A table has its true size.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def roots(links: DataFrame) -> DataFrame:
    """(node, up) -> (node, root), where a node that is its own up, or no node at all, is a root; each round follows twice as many links."""
    d = cut(links.toDF("node", "up"))
    while True:
        over = d.where("node <> up").toDF("_n", "_u")
        nxt = cut(d.join(over, d.up == over["_n"], "left").select("node", F.coalesce("_u", "up").alias("up"), F.col("_u").isNotNull().alias("moved")))
        d = nxt.select("node", "up")
        if nxt.where("moved").head() is None:
            return d.toDF("node", "root")


def hooked(least: DataFrame) -> DataFrame:
    """(node, to): the other end of every node's least edge, in a total order of edges -> (node, root) of the trees that they make.

    Such edges make no circle but that of the one edge which is least for both its ends; the smaller end is the root.
    """
    back = least.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
    mutual = (F.col("_t") == F.col("node")) & (F.col("node") < F.col("to"))
    return roots(least.join(back, least["to"] == back["_n"], "left").select("node", F.when(mutual, F.col("node")).otherwise(F.col("to")).alias("up")))


def spanning_forest(nodes: DataFrame, edges: DataFrame, further: Callable[[DataFrame, DataFrame], tuple[DataFrame | None, DataFrame | None]] | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node); edges (u, v, w, a, b: ends u < v, and an order by (w, a, b) that is the same for no two edges of different ends)
    -> (the minimum spanning forest's edges, (node, root)).

    Each round every component takes its least outgoing edge and contracts along it, so at most log2(nodes) rounds are made. The edges may be
    a choice of a larger graph: further(labels, best) gets (node, comp) and each component's (comp, w, a, b, u, v) and returns
    edges in the columns u, v, w, a, b that may be less than those, or None, and the components (comp) that take no edge in this round, or None. A
    component that is not among them must have its least edge of all then, and as long as any graph has edges to take, not all of its components may wait.
    """
    labels = cut(nodes.select("node", F.col("node").alias("comp")))
    edges, forest, order = cut(edges.select("u", "v", "w", "a", "b")), None, F.struct("w", "a", "b", "u", "v")
    while True:
        of = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias("c" + x))
        outgoing = lambda e: e.join(of("u"), "u").join(of("v"), "v").where("cu <> cv")
        out = cut(outgoing(edges))
        ends = lambda d: d.select(F.explode(F.array("cu", "cv")).alias("comp"), order.alias("x")).groupBy("comp").agg(F.min("x").alias("x"))
        best = ends(out)
        if further is not None:
            best = cut(best)
            more, waiting = further(labels, best.select("comp", "x.*"))
            if more is not None:
                best = ends(out.unionByName(outgoing(more)))
            if waiting is not None:
                best = best.join(waiting, "comp", "left_anti")
        best = cut(best.select("comp", "x.*"))
        if best.head() is None:
            return (forest if forest is not None else edges.limit(0)), labels.toDF("node", "root")
        taken = best.select("u", "v", "w", "a", "b").distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        to = best.join(of("u"), "u").join(of("v"), "v").select(F.col("comp").alias("node"), F.when(F.col("cu") == F.col("comp"), F.col("cv")).otherwise(F.col("cu")).alias("to"))
        top = hooked(to).select(F.col("node").alias("comp"), "root")
        labels = cut(labels.join(top, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        edges = out.drop("cu", "cv")
