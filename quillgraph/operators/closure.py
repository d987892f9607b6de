"""Transitive closure over blank nodes, and what is built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import carried
from ..plans.session import checkpoint
from ..vocab import TYPE

#: Hops after which the nodes found so far are written, to keep plans short.
STRETCH = 4


def blank_edges(triples: DataFrame) -> DataFrame:
    """``record_id, s, o``: edges to blank nodes."""
    return triples.where("o_kind = 'b'").select("record_id", "s", "o").distinct()


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All ``record_id, root, node`` reached from seeds of that form, seeds included; columns that seeds have besides go along.

    Every hop joins only the nodes new since the last one, keyed by record and node, and leaves out what has been seen, so
    cycles end and shared nodes are taken once. No edge leaves its record, so only edges of the seeds' records are kept.
    Chains are as deep as lists are long, so plans are cut now and then.
    """
    keys = seeds.columns
    also = [c for c in keys if c not in ("record_id", "node")]
    seen = checkpoint(seeds.distinct())
    if seen.isEmpty():
        return seen
    own = edges.join(seen.select("record_id").distinct(), "record_id", "left_semi")
    edges = checkpoint(own.select("record_id", F.col("s").alias("node"), "o"))  # narrow; read once a hop
    front, hops = seen, 0
    while True:
        step = front.join(edges, ["record_id", "node"]).select("record_id", *also, F.col("o").alias("node")).distinct()
        front = checkpoint(step.join(seen, keys, "left_anti").select(*keys))
        if front.isEmpty():
            return seen
        seen, hops = seen.unionByName(front), hops + 1
        if hops % STRETCH == 0:
            seen = checkpoint(seen)


def description(triples: DataFrame, roots: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The concise bounded description of each root: its own triples and, over blank nodes, those they lead to.

    ``roots`` has ``record_id, class, entity``; the result adds the triples' columns. Triples with a term of the local
    or terms namespace as predicate or object are left out, and blank nodes are not followed through them. The triples
    themselves are moved once, to the nodes of the descriptions. ``links`` are triples with all those to blank nodes among
    them, where these are at hand.
    """
    kept = triples.where(carried())
    edges = blank_edges((triples if links is None else links).where(carried()))
    members = reach(edges, roots.select("record_id", "class", "entity", F.col("entity").alias("node")))
    owned = members.join(kept.withColumnRenamed("s", "node"), ["record_id", "node"])
    return owned.select("record_id", "entity", "class", F.col("node").alias("s"), "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")


def without_nodes(triples: DataFrame, links: DataFrame) -> DataFrame:
    """``triples`` without the links ``record_id, s, p, o`` to blank nodes and all that is reached from those."""
    seeds = links.select("record_id", F.col("o").alias("root"), F.col("o").alias("node"))
    gone = reach(blank_edges(triples), seeds).select("record_id", F.col("node").alias("s")).distinct()
    return triples.join(gone, ["record_id", "s"], "left_anti").join(links.select("record_id", "s", "p", "o").distinct(), ["record_id", "s", "p", "o"], "left_anti")


def links_by_type(triples: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Links to blank nodes by (predicate, type of the node)."""
    pairs = triples.sparkSession.createDataFrame(rules, "p string, type string") if rules else triples.sparkSession.createDataFrame([], "p string, type string")
    typed = triples.where((F.col("p") == TYPE) & (F.col("s_kind") == "b")).select("record_id", F.col("s").alias("o"), F.col("o").alias("type"))
    return triples.where("o_kind = 'b'").select("record_id", "s", "p", "o").join(F.broadcast(pairs), "p").join(typed, ["record_id", "o", "type"], "left_semi").select("record_id", "s", "p", "o")
