"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.scratch import Scratch

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, scratch: Scratch | None = None, src: str = "src", dst: str = "dst", report: list[tuple[int, int]] | None = None) -> DataFrame:
    """(node, label) of every node with an edge; the label is the smallest node of the component.

    In each round nodes are put in a new random order, by a hash, and each one moves to the first of itself and its
    neighbours. Edges are written anew between the nodes moved to, without loops and repeats, so that both nodes and edges
    become fewer by a constant factor on average, chains and stars alike. At the end the moves are followed backwards from the last round,
    and each component takes its smallest node. A node's neighbours are aggregated before they are sent, and every join has
    one row for a key on one side, so Spark can split a hot one on the other. Each round is a written table.

    Loops, repeated and reversed edges do no harm; a node with loops alone is its own component; edges with a null end are
    ignored. `report` gets the nodes and the edges (both ways) of each round.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    left = scratch.keep(pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    rounds: list[DataFrame] = []
    for k in range(MAX_ROUNDS):
        place = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("node"))
        first = left.groupBy("src").agg(F.min(place("dst")).alias("near"))
        moves = scratch.keep(first.select(F.col("src").alias("node"), F.least("near", place("src"))["node"].alias("to")))
        rounds.append(moves)
        to = lambda c: moves.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        moved = left.join(to("src"), "src").join(to("dst"), "dst").select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst"))
        fresh = scratch.keep(moved.where("src <> dst").distinct())
        if report is not None:
            report.append((moves.count(), left.count()))
        scratch.drop(left)
        left = fresh
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # backwards: where the nodes of a round end
    ends = rounds[-1]
    for moves in reversed(rounds[:-1]):
        up = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        ends = moves.join(up, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    ends = scratch.keep(ends)
    least = ends.groupBy("to").agg(F.min("node").alias("label"))
    out = scratch.keep(ends.join(least, "to").select("node", "label"))
    scratch.drop(left, ends, *rounds)
    return out
