"""Splits that keep related records together.

Records and the entities they name form a graph; its components are found by breadth-first
search from many seeds at once over hash-partitioned adjacency rows. Where searches meet,
their labels are merged in a graph of labels, which is searched the same way until it is
small enough for one task. Components are then laid along the order of their hashes and
cut at the shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.session import cut, running_sums

#: One node in so many is a seed; rounds of expansion; edges that one task may merge.
SEEDS, ROUNDS, SMALL = 4, 3, 200_000
#: Neighbours of a node at most; an entity with more is divided into linked parts.
DEGREE = 1000


def adjacency(pairs: DataFrame, record: str, entity: str) -> DataFrame:
    """Edges (``u``, ``v``), both ways, of records and the entities that at least two of them name.

    An entity that very many records name becomes a tree: its records lie under leaves of
    about DEGREE each, these under nodes of about DEGREE leaves, and so on up to one root.
    So no node has a hot list of neighbours, and paths grow by two steps a level.
    """
    links = cut(pairs.select(F.col(record).cast("string").alias("r"), F.col(entity).cast("string").alias("e")).dropna().distinct())
    degree = links.groupBy("e").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(links.join(degree, "e").select("r", "e", "n", F.xxhash64("r").alias("h")))
    leaf = F.pmod("h", F.ceil(F.col("n") / DEGREE))

    def node(level: int) -> Column:
        return F.concat(F.lit(f"p{level} "), F.floor(leaf / DEGREE ** (level - 1)).cast("string"), F.lit(" "), F.col("e"))

    edges = shared.select(F.concat(F.lit("r"), F.col("r")).alias("u"), node(1).alias("v"))
    largest = shared.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    level = 1
    while largest > DEGREE**level:
        more = shared.filter(F.col("n") > DEGREE**level).select(node(level).alias("u"), node(level + 1).alias("v")).distinct()
        edges = edges.unionByName(more)
        level += 1
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the few edges of a small graph."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for part in parts:
        for u, v in zip(part["u"], part["v"]):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        names = list(root)
        yield pd.DataFrame({"node": names, "label": [find(x) for x in names]})


def component_labels(edges: DataFrame, level: int = 0) -> DataFrame:
    """Rows (``node``, ``label``): equal labels for the nodes of one component.

    ``edges`` (``u``, ``v``) must hold both directions. Each level draws its seeds anew, as
    the nodes of a level are the seeds of the one before.
    """
    edges = cut(edges.repartition("u"))
    nodes = edges.select(F.col("u").alias("node")).distinct()
    seed = F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(SEEDS)) == 0
    labels = cut(nodes.filter(seed).select("node", F.col("node").alias("label")))
    frontier = labels
    for _ in range(ROUNDS):
        reached = (
            frontier.join(edges, F.col("node") == F.col("u"))
            .groupBy(F.col("v").alias("node"))
            .agg(F.min("label").alias("label"))
        )
        frontier = cut(reached.join(labels.select("node"), "node", "left_anti"))
        labels = labels.unionByName(frontier)
    # What no search has reached begins one of its own.
    labels = cut(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    # Searches that touch: an edge whose ends bear different labels.
    touching = cut(
        edges.join(labels.select(F.col("node").alias("u"), F.col("label").alias("a")), "u")
        .join(labels.select(F.col("node").alias("v"), F.col("label").alias("b")), "v")
        .filter("a <> b")
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
        .distinct()
    )
    n = touching.count()
    if n == 0:
        return labels
    merged = (
        touching.coalesce(1).mapInPandas(_merge, "node string, label string")
        if n <= SMALL
        else component_labels(touching, level + 1)
    )
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return labels.join(merged, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def groups(pairs: DataFrame, record: str, entity: str) -> DataFrame:
    """Rows (``record``, ``group``) of the records that must stay with at least one other.

    ``group`` is the smallest record of all that hang together, directly or through others.
    Null records and null entities tie nothing; repeated rows count once; an empty table
    gives no rows.
    """
    labels = component_labels(adjacency(pairs, record, entity)).filter("node like 'r%'")
    labels = cut(labels.select(F.expr("substring(node, 2)").alias(record), "label"))
    least = labels.groupBy("label").agg(F.min(record).alias("group"))
    return labels.join(least, "label").select(record, "group")


def assign_splits(records: DataFrame, record: str, grouped: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Rows (``record``, ``split``): whole groups per split, in sizes as close to ``shares`` as that allows.

    ``grouped`` has (``record``, ``group``); records that are absent there are groups of
    their own. Groups larger than a five-hundredth of all records (at most 500) are placed
    first, the largest first, each where most is missing; the others lie in the order of
    their hashes and fill the rest. Null records get no split, repeated ones one row.
    """
    names = sorted(shares, key=lambda s: (-shares[s], s))
    if not names or any(v < 0 for v in shares.values()) or sum(shares.values()) <= 0:
        raise ValueError("shares must be positive")
    own = records.select(record).dropna().distinct().join(grouped, record, "left")
    own = cut(own.select(record, F.coalesce("group", record).alias("_g")))
    sizes = cut(own.groupBy("_g").agg(F.count("*").alias("_n")))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    want = {s: shares[s] / sum(shares.values()) * total for s in names}
    large = sizes.filter(F.col("_n") > max(1, total / 500)).orderBy(F.col("_n").desc(), "_g").collect()
    placed = []
    for r in large:
        best = max(names, key=lambda s: want[s])
        want[best] -= r["_n"]
        placed.append((r["_g"], best))
    spark = records.sparkSession
    fixed = spark.createDataFrame(placed, "_g string, split string")
    rest = sizes.join(F.broadcast(fixed), "_g", "left_anti")  # at most 500 rows
    line = running_sums(rest, [], [F.xxhash64("_g").asc(), F.col("_g").asc()], {"_end": "_n"})
    left = {s: max(0.0, want[s]) for s in names}
    scale = (total - sum(r["_n"] for r in large)) / (sum(left.values()) or 1)
    middle, border, split = F.col("_end") - F.col("_n") / 2, 0.0, F.lit(names[0])
    cases = None
    for s in names:
        border += left[s] * scale
        cases = F.when(middle <= border, s) if cases is None else cases.when(middle <= border, s)
    split = cases.otherwise(names[-1] if left[names[-1]] else names[0])
    chosen = line.select("_g", split.alias("split")).unionByName(fixed)
    return own.join(chosen, "_g").select(record, "split")
