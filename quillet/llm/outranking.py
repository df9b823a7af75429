"""One ranking from scores on different scales, by outranking net flow.

Each score is turned into a percentile among all items of the question; items that a score
does not have share the lowest place. Of two items the one with the higher percentile is
preferred to the degree min(1, difference / threshold). What an item gains over all others
minus what it loses is its net flow. The sums over all pairs come from sorted prefix sums,
never from pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.session import cut, running_sums
from quillet.sources.rankings import run_items

#: Items of a group, over all its sources, that one task may hold; larger groups are spread.
LARGE = 300_000
#: Items that a task works on at once.
CHUNK = 200_000


def net_flows(
    items: DataFrame, group: str, source: str, item: str, score: str, threshold: float = 0.5, weights: DataFrame | None = None
) -> DataFrame:
    """Rows (``group``, ``item``, ``flow``): the weighted sum of net flows over all sources.

    items has one row per (group, source, item) with a score that is neither null nor NaN.
    Each source counts the same, or by ``weights`` (``source``, ``weight``). The flow of an
    item that a source lacks is its zero: absence gains nothing. Ties share a percentile. A
    group with one item has flow 0. An empty table gives no rows.
    """
    rows = cut(items.select(F.col(group).alias("g"), F.col(source).alias("r"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")))
    universe = rows.select("g", "i").distinct().groupBy("g").agg(F.count("*").alias("n"))
    blocks = rows.groupBy("g", "r", "s").agg(F.count("*").alias("c"))
    present = blocks.groupBy("g", "r").agg(F.sum("c").alias("m")).join(universe, "g")
    absent = present.filter("n > m").select("g", "r", F.lit(None).cast("double").alias("s"), (F.col("n") - F.col("m")).alias("c"))
    ranked = running_sums(blocks.unionByName(absent), ["g", "r"], [F.col("s").asc_nulls_first()], {"upto": "c"}).join(universe, "g")
    ranked = cut(ranked.withColumn("p", (F.col("upto") - F.col("c") / 2) / F.col("n")))
    # Prefix sums of counts and of percentiles at each percentile and a threshold below and above it.
    points = ranked.select(
        "g", "r", "s", "n", "p",
        F.explode(
            F.array(
                F.struct(F.col("p").alias("x"), F.lit(0).alias("k"), F.col("c").cast("double").alias("c"), (F.col("c") * F.col("p")).alias("w")),
                *(F.struct((F.col("p") + d * threshold).alias("x"), F.lit(k).alias("k"), F.lit(0.0).alias("c"), F.lit(0.0).alias("w")) for d, k in ((-1, 1), (1, 2))),
            )
        ).alias("e"),
    ).select("g", "r", "s", "n", "p", "e.*")
    sums = running_sums(points, ["g", "r"], [F.col("x").asc(), F.col("k").asc(), F.col("p").asc()], {"cs": "c", "ws": "w"})
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    looked = sums.groupBy("g", "r", "s", "n", "p").agg(
        *(at(c, k).alias(f"{c}{k}") for c in ("cs", "ws") for k in (0, 1, 2))
    )
    gain = F.expr(f"cs1 + (p * (cs0 - cs1) - (ws0 - ws1)) / {threshold}")
    loss = F.expr(f"(n - cs2) + ((ws2 - ws0) - p * (cs2 - cs0)) / {threshold}")
    flows = looked.withColumn("f", F.when(F.col("n") > 1, (gain - loss) / (F.col("n") - 1)).otherwise(F.lit(0.0)))
    floor = flows.filter("s is null").select("g", "r", F.col("f").alias("low"))
    flows = flows.filter("s is not null").join(floor, ["g", "r"], "left").select(
        "g", "r", "s", (F.col("f") - F.coalesce("low", F.lit(0.0))).alias("f")
    )
    made = rows.join(flows, ["g", "r", "s"])
    if weights is not None:
        made = made.join(weights.select(F.col(source).alias("r"), F.col("weight").alias("_w")), "r", "left").withColumn("f", F.col("f") * F.coalesce("_w", F.lit(0.0)))
    return made.groupBy("g", "i").agg(F.sum("f").alias("f")).select(
        F.col("g").alias(group), F.col("i").alias(item), F.round("f", 9).alias("flow")
    )


def flows_of_arrays(
    g: np.ndarray, r: np.ndarray, i: np.ndarray, s: np.ndarray, weight: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, item and flow of whole groups given by their codes, with the weight of each source; the same sums as net_flows, in arrays."""
    order = np.lexsort((-s, i, r, g))
    g, r, i, s = g[order], r[order], i[order], s[order]
    first = np.ones(len(g), bool)  # a document's highest score in a source
    first[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1]) | (i[1:] != i[:-1])
    g, r, i, s = g[first], r[first], i[first], s[first]
    pairs, at = np.unique(np.stack([g, i]), axis=1, return_inverse=True)
    at = at.ravel()
    universe = np.bincount(pairs[0], minlength=int(g.max()) + 1)
    order = np.lexsort((s, r, g))
    g, r, s, at = g[order], r[order], s[order], at[order]
    # Segments are a source of a group; blocks are the equal scores of a segment.
    new_segment = np.ones(len(g), bool)
    new_segment[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    new_block = new_segment.copy()
    new_block[1:] |= s[1:] != s[:-1]
    block = np.cumsum(new_block) - 1
    segment = (np.cumsum(new_segment) - 1)[new_block]
    count = np.bincount(block).astype(np.float64)
    size = np.bincount(segment, weights=count)
    n = universe[g[new_segment]].astype(np.float64)
    absent = n - size
    # Each segment gets a block of what it lacks, before its others.
    segments = len(size)
    seg = np.concatenate([np.arange(segments), segment])
    c = np.concatenate([absent, count])
    order = np.argsort(seg, kind="stable")
    seg, c = seg[order], c[order]
    start = np.searchsorted(seg, np.arange(segments))
    upto = np.cumsum(c)
    upto -= (upto[start] - c[start])[seg]
    p = (upto - c / 2) / n[seg]
    counts, weights = np.concatenate([[0.0], np.cumsum(c)]), np.concatenate([[0.0], np.cumsum(c * p)])
    keys = seg * 4.0 + p

    def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = np.maximum(np.searchsorted(keys, seg * 4.0 + np.clip(x, -1.0, 2.0), side="right"), start[seg])
        return counts[to] - counts[start][seg], weights[to] - weights[start][seg]

    own_c, own_w = upto, np.concatenate([[0.0], np.cumsum(c * p)])[np.arange(len(c)) + 1] - weights[start][seg]
    low_c, low_w = sums(p - threshold)
    high_c, high_w = sums(p + threshold)
    gain = low_c + (p * (own_c - low_c) - (own_w - low_w)) / threshold
    loss = (n[seg] - high_c) + ((high_w - own_w) - p * (high_c - own_c)) / threshold
    flow = (gain - loss) / np.maximum(n[seg] - 1, 1)
    zero = np.where(absent > 0, flow[start], 0.0)
    gained = flow - zero[seg]
    real = np.ones(len(c), bool)
    real[start] = False
    total = np.bincount(at, weights=gained[real][block] * weight[r], minlength=pairs.shape[1])
    return pairs[0], pairs[1], np.round(total, 9)


def _whole_groups(threshold: float, weights: dict | None, kind: pa.DataType, id_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pd.DataFrame] = []

        def made(frame: pd.DataFrame) -> pa.RecordBatch:
            g, groups = pd.factorize(frame["g"], use_na_sentinel=False)
            r, sources = pd.factorize(frame["r"], use_na_sentinel=False)
            i, items = pd.factorize(frame["i"])
            weight = np.array([1.0 if weights is None else weights.get(x, 0.0) for x in sources])
            a, b, flow = flows_of_arrays(g, r, i, frame["s"].to_numpy(), weight, threshold)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(groups, dtype=object)[a], kind, from_pandas=True), pa.array(np.asarray(items, dtype=object)[b], id_kind), pa.array(flow)], names=["g", "i", "f"]
            )

        for batch in batches:
            lists = batch.column("ranked")
            inner, parents = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            frame = pd.DataFrame(
                {
                    "g": batch.column("g").to_pandas().to_numpy()[parents], "r": batch.column("r").to_pandas().to_numpy()[parents],
                    "i": pc.struct_field(inner, "doc_id").to_pandas(), "s": pc.struct_field(inner, "score").to_pandas().astype("float64"),
                }
            )
            frame = frame[frame["i"].notna() & frame["s"].notna()]
            if len(frame):
                kept.append(frame)
            if sum(map(len, kept)) >= CHUNK:
                whole = pd.concat(kept, ignore_index=True)
                # Rows come sorted by group: all but the last group are complete.
                last = whole["g"].iloc[-1]
                end = whole["g"].isna() if last is None or last != last else whole["g"] == last
                kept = [whole[end]]
                if not end.all():
                    yield made(whole[~end])
        if kept:
            yield made(pd.concat(kept, ignore_index=True))

    return run


def run_flows(
    runs: DataFrame, group: str = "qid", source: str = "run_id", threshold: float = 0.5, weights: dict | None = None
) -> DataFrame:
    """net_flows of nested rankings (``group``, ``source``, ``ranked`` of (doc_id, score)): (``group``, ``doc_id``, ``flow``).

    Rows of ordinary groups are shuffled once, as nested as they are, and whole groups are
    worked off in arrays. Groups of more than LARGE items, which no one task may hold, go
    through net_flows, which spreads each over many tasks; the results are the same. Each
    source counts the same, or by ``weights``; one that these do not name counts nothing. Null items, null ids and null or NaN
    scores do not exist; slices are read together with a document's highest score; null
    groups and sources are left out; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = runs.select(F.col(group).alias("g"), F.col(source).alias("r"), "ranked").filter("g is not null and r is not null and size(ranked) > 0")
    large = rows.groupBy("g").agg(F.sum(F.size("ranked")).alias("n")).filter(F.col("n") > LARGE).select("g")
    large = cut(large)  # as many rows as LARGE goes into the items, at most
    kind, id_kind = rows.schema["g"].dataType, rows.schema["ranked"].dataType.elementType["doc_id"].dataType
    schema = f"g {kind.simpleString()}, i {id_kind.simpleString()}, f double"
    run = _whole_groups(threshold, weights, to_arrow_type(kind), to_arrow_type(id_kind))

    def whole(some: DataFrame) -> DataFrame:
        made = some.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)
        return made.select(F.col("g").alias(group), F.col("i").alias("doc_id"), F.col("f").alias("flow"))

    if large.isEmpty():
        return whole(rows)
    items = run_items(rows.join(large, "g", "left_semi"), ["g", "r"])
    counted = None
    if weights is not None:
        counted = runs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], f"r {rows.schema['r'].dataType.simpleString()}, weight double")
    spread = net_flows(items, "g", "r", "doc_id", "score", threshold, counted)
    return whole(rows.join(large, "g", "left_anti")).unionByName(spread.withColumnRenamed("g", group))


def combined_ranking(flows: DataFrame, group: str, item: str, top: int | None = None) -> DataFrame:
    """Places from 1 by falling flow, ties by the smaller item; only the first ``top`` where given.

    The full ranking numbers by distributed running sums, so that no group meets in one task.
    """
    if top is not None:
        best = Window.partitionBy(group).orderBy(F.col("flow").desc(), F.col(item).asc())
        return flows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
    numbered = running_sums(
        flows.withColumn("_one", F.lit(1)), [group], [F.col("flow").desc(), F.col(item).asc()], {"place": "_one"}
    )
    return numbered.select(group, item, "flow", F.col("place").cast("int").alias("place"))
