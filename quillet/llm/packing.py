"""Filling containers of fixed capacity with items that are never split without need.

Only the histogram of lengths, which is bounded by the capacity, comes to the driver. Its
larger lengths are grouped linearly, and a configuration linear program over the groups is
solved by multiplicative weights, whose pricing step is an exact knapsack by dynamic
programming. Amounts are rounded to whole containers, whose items are drawn by their exact
lengths; what is left, the short items among it, goes by best fit into the room of these
containers and then into new ones. The plan is a list of runs whose number follows the
capacity, not the items; an item finds its container by its number within its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.bpe import token_counts
from quillet.session import cut, running_sums

#: Groups of lengths in the program at most; with no more lengths than that each is its own.
GROUPS = 256
#: Items of less than this part of the capacity fill gaps and take no part in the program.
SHORT = 16
#: Steps of the weights, and how fast a group loses weight that is covered more than its time.
ROUNDS, ETA = 256, 1.0
#: Parts of the program's amounts that are tried.
PARTS = (1.0, 0.75, 0.5, 0.25)


def _price(weights: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest value: an unbounded knapsack, exact for whole weights.

    ``weights`` ascend. Items are taken in bundles of 1, 2, 4 ..., each a column step over
    all fillings at once; an item that a lighter one outweighs in value never pays.
    """
    before = np.concatenate([[0.0], np.maximum.accumulate(values)[:-1]])
    best, steps = np.zeros(capacity + 1), []
    for i in np.flatnonzero(values > before):
        size, value = int(weights[i]), float(values[i])
        bundle = 1
        while size * bundle <= capacity:
            at = size * bundle
            made = best[: capacity + 1 - at] + value * bundle
            better = made > best[at:]
            np.copyto(best[at:], made, where=better)
            steps.append((i, bundle, at, better))
            bundle *= 2
    config, room = np.zeros(len(weights), dtype=np.int64), capacity
    for i, bundle, at, better in reversed(steps):
        if room >= at and better[room - at]:
            config[i] += bundle
            room -= at
    return config


def fractional_configurations(weights: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and their amounts that nearly cover all counts, by multiplicative weights.

    The prices of the program's dual lie near the lengths, so weights begin there; a group
    that is covered ahead of its time loses weight exponentially, one that lags gains it.
    Each step adds an equal amount of the configuration that is worth most at these weights.
    """
    step = max(float((weights * counts).sum()) / capacity, 1.0) / ROUNDS
    covered = np.zeros(len(weights))
    made: dict[bytes, tuple[np.ndarray, float]] = {}
    for k in range(ROUNDS):
        config = _price(weights, weights * np.exp(-ETA * (covered - k / ROUNDS)), capacity)
        covered += step * config / counts
        key = config.tobytes()
        made[key] = (config, made.get(key, (config, 0.0))[1] + step)
    return sorted(made.values(), key=lambda x: -x[1])


class Plan:
    """Runs (size, first item number, items per container, first container), sorted, and the number of containers."""

    def __init__(self, sizes: dict[int, int], capacity: int):
        self.sizes = np.array(sorted(sizes), dtype=np.int64)
        self.left = {int(s): int(sizes[s]) for s in sorted(sizes)}
        self.there = sorted(self.left)
        self.drawn = dict.fromkeys(self.left, 0)
        self.capacity = capacity
        self.open: dict[int, list[tuple[int, list]]] = {}
        self.closed: list[tuple[int, list]] = []

    def _take(self, size: int, each: int, containers: int) -> tuple[int, int, int]:
        part = (size, self.drawn[size], each)
        self.drawn[size] += each * containers
        self.left[size] -= each * containers
        return part

    def _put(self, containers: int, parts: list, room: int) -> None:
        if room:
            self.open.setdefault(room, []).append((containers, parts))
        else:
            self.closed.append((containers, parts))

    def fill(self, wanted: list[tuple[list[int], int]], containers: int) -> None:
        """Up to so many containers of one configuration of (sizes of a group, falling; number), the largest group first.

        Items are drawn from the largest left of their group. Groups are as heavy as their
        largest, so some room is gained: the last item is the largest at all that fits into it.
        """
        while containers > 0:
            draws: dict[int, int] = {}
            alike, room = True, self.capacity
            for own, number in wanted:
                need = number - (own is wanted[-1][0])
                for s in own:
                    n = min(need, self.left[s] - draws.get(s, 0))
                    if n:
                        draws[s] = draws.get(s, 0) + n
                        room -= s * n
                        # As many containers alike as this size gives; one where the next size has to help.
                        alike &= n == need
                        need -= n
                    if not need:
                        break
            at = bisect_right(self.there, room) - 1
            while at >= 0 and self.left[self.there[at]] <= draws.get(self.there[at], 0):
                if not self.left[self.there[at]]:
                    del self.there[at]
                at -= 1
            if at >= 0:
                draws[self.there[at]] = draws.get(self.there[at], 0) + 1
                room -= self.there[at]
            if not draws:
                return
            most = min(containers, *(self.left[s] // n for s, n in draws.items())) if alike else 1
            self._put(most, [self._take(s, n, most) for s, n in draws.items()], room)
            containers -= most

    def best_fit(self) -> None:
        """All that is left, the largest first, into the least room that holds it, else into new containers."""
        for size in self.sizes[::-1].tolist():
            while self.left[size]:
                room = min((r for r in self.open if r >= size), default=None)
                if room is None:
                    held, parts, room = self.left[size], [], self.capacity
                else:
                    held, parts = self.open[room].pop()
                    if not self.open[room]:
                        del self.open[room]
                # A container that was opened for an item holds as many of its like as fit: it has the least room then.
                each = min(room // size, self.left[size])
                some = min(held, self.left[size] // each)
                if parts and some < held:
                    self._put(held - some, [(s, first + some * n, n) for s, first, n in parts], room)
                self._put(some, [*parts, self._take(size, each, some)], room - each * size)

    def finish(self) -> tuple[int, np.ndarray]:
        rows, containers = [], 0
        for held, parts in [*self.closed, *(g for groups in self.open.values() for g in groups)]:
            rows += [(size, first, each, containers) for size, first, each in parts]
            containers += held
        return containers, np.array(sorted(rows) or [(0, 0, 1, 0)], dtype=np.int64)


def linear_groups(sizes: dict[int, int], capacity: int) -> list[list[int]]:
    """Lengths that are not short in at most GROUPS groups of about equal numbers of items, each falling."""
    long = [s for s in sorted(sizes) if s * SHORT >= capacity]
    if len(long) <= GROUPS:
        return [[s] for s in long]
    upto = np.cumsum([sizes[s] for s in long])
    group = np.minimum((upto - 1) * GROUPS // upto[-1], GROUPS - 1)
    return [[s for s, g in zip(long, group) if g == k][::-1] for k in sorted(set(group.tolist()))]


def plan_containers(sizes: dict[int, int], capacity: int) -> tuple[int, np.ndarray]:
    """The number of containers and the runs for a histogram ``size -> number of items``.

    The program's amounts, or parts of them, are rounded down, the rest is filled by best
    fit, and the first of these with the fewest containers is taken. Where none needs as few
    as best fit alone, as may happen where each length has few items, the result is the
    latter: it never has more. One way for all sizes of input.
    """
    if any(s < 1 or s > capacity for s in sizes):
        raise ValueError("sizes must lie between 1 and the capacity")
    made = []
    groups = linear_groups(sizes, capacity)
    if groups:
        weights = np.array([g[0] for g in groups], dtype=np.int64)
        counts = np.array([sum(sizes[s] for s in g) for g in groups], dtype=np.float64)
        configurations = fractional_configurations(weights, counts, capacity)
        for part in PARTS:
            plan = Plan(sizes, capacity)
            for config, amount in configurations:
                plan.fill([(groups[i], int(config[i])) for i in np.flatnonzero(config)[::-1]], int(part * amount))
            made.append(plan)
    made.append(Plan(sizes, capacity))
    for plan in made:
        plan.best_fit()
    return min((plan.finish() for plan in made), key=lambda x: x[0])


def pack_texts(df: DataFrame, key: str, column: str, capacity: int = 4096, path: str | None = None) -> DataFrame:
    """Rows (``container`` BIGINT, ``key``, ``first_token`` INT, ``end_token`` INT).

    A text of at most ``capacity`` tokens lies whole in one container. A longer one fills
    containers of its own and its rest is packed like a text; the ranges are half open.
    Null and empty texts give no row; repeated rows are packed as often as they occur; an
    empty table gives an empty result. Other columns are left out, so none can clash.
    """
    counts = cut(token_counts(df, key, column, path, "_tokens").filter("_tokens > 0"))
    size = F.when(F.col("_tokens") <= capacity, F.col("_tokens")).otherwise(F.col("_tokens") % capacity)
    items = counts.select(
        key, F.col("_tokens").alias("_to"), size.cast("long").alias("_size"), F.lit(1).cast("long").alias("_one")
    ).filter("_size > 0")
    # At most one row per token of the capacity.
    histogram = {r[0]: r[1] for r in items.groupBy("_size").count().collect()}
    containers, runs = plan_containers(histogram, capacity)
    numbered = running_sums(items, ["_size"], [F.col(key).asc()], {"_number": "_one"})
    shared = df.sparkSession.sparkContext.broadcast(runs)  # runs follow the capacity, not the data

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        span = np.int64(1) << 40
        keys = table[:, 0] * span + table[:, 1]
        for part in parts:
            number, size = part["_number"].to_numpy() - 1, part["_size"].to_numpy()
            run = table[np.searchsorted(keys, size * span + number, side="right") - 1]
            yield pd.DataFrame(
                {
                    "container": run[:, 3] + (number - run[:, 1]) // run[:, 2],
                    key: part[key],
                    "first_token": (part["_to"] - size).astype("int32"),
                    "end_token": part["_to"].astype("int32"),
                }
            )

    kind = df.schema[key].dataType.simpleString()
    schema = f"container bigint, `{key}` {kind}, first_token int, end_token int"
    packed = numbered.mapInPandas(place, schema)
    full = counts.filter(F.col("_tokens") > capacity).select(
        key, F.expr(f"cast(_tokens div {capacity} as bigint)").alias("_full")
    )
    full = running_sums(full, [], [F.col(key).asc()], {"_upto": "_full"})
    own = full.select(key, "_full", "_upto", F.explode(F.expr("sequence(0L, _full - 1)")).alias("_i")).select(
        (F.lit(containers) + F.col("_upto") - F.col("_full") + F.col("_i")).alias("container"),
        key,
        (F.col("_i") * capacity).cast("int").alias("first_token"),
        ((F.col("_i") + 1) * capacity).cast("int").alias("end_token"),
    )
    return packed.unionByName(own)
