"""Sessions, cutting of lineage and distributed running sums."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the given one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillet")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a checkpoint in the shared folder.

    The folder is the one that the session names in ``spark.checkpoint.dir``. Where that is
    unset, a folder of this machine is taken if the master is local, as in tests; a cluster
    must name one that all its machines share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="quillet-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, which may run where it is not installed; once per context."""
    context = spark.sparkContext
    if getattr(context, "_quillet_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillet-code-"), "quillet.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._quillet_shipped = True


def slices(spark: SparkSession) -> int:
    """Number of partitions for explicit range and hash partitioning."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)


def running_sums(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]
) -> DataFrame:
    """Exact inclusive running sums per group, none of whose groups sits in one task.

    df is range-partitioned by keys and order, so that a group with a third of all rows
    spreads over many tasks. Each task sums its own part; what a group holds in earlier
    partitions is added from a table that has rows only for groups that cross a border
    between partitions (at most one such group per border).

    sums maps each new column to the numeric column it sums. Rows that tie in ``order``
    get their sums in an unspecified order among themselves; make ``order`` total where
    that matters. Empty input gives empty output; nulls in summed columns count as 0.
    """
    n = slices(df.sparkSession)
    ordered = [F.col(k).asc() for k in keys] + order
    placed = cut(
        df.repartitionByRange(n, *ordered).withColumn("_part", F.spark_partition_id())
    )
    totals = placed.groupBy("_part", *keys).agg(
        *(F.sum(c).alias(f"_t_{new}") for new, c in sums.items())
    )
    crossing = totals.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1") if keys else None
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if keys:
        several = crossing.select(*(F.col(k).alias(f"_s_{k}") for k in keys))
        totals = totals.join(several, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]), "left_semi")
    offsets = totals.select(
        "_part", *keys, *(F.sum(f"_t_{new}").over(over).alias(f"_o_{new}") for new in sums)
    )
    # At most two rows per partition: the first and the last group of it can cross. Null keys are a group.
    offsets = offsets.select(F.col("_part").alias("_b_part"), *(F.col(k).alias(f"_b_{k}") for k in keys), *(f"_o_{new}" for new in sums))
    same = F.col("_part") == F.col("_b_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    rows = placed.join(F.broadcast(offsets), same, "left")
    inside = (
        Window.partitionBy("_part", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.select(
        *df.columns,
        *(
            (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(f"_o_{new}", F.lit(0))).alias(new)
            for new, c in sums.items()
        ),
    )
