"""Run log, correlation with a leaderboard, configurations, models and frozen pipelines (driver side)."""

from __future__ import annotations

import datetime
import hashlib
import json
import platform
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns of the log.
FIELDS = (
    "run_id date task phase chunking retriever negatives reranker cutoff_rule dev_P dev_R dev_official leaderboard n_params config git_tag seed notes"
).split()
LOG = "logged_at bigint, " + ", ".join(f"{c} string" for c in FIELDS)
PARAMETER_CEILING = 4_000_000_000


def append_run(spark: SparkSession, folder: str, **values: object) -> None:
    """Add one entry to the log, a folder of JSON rows that any number of writers may append to.

    Values that are no columns of the log are kept together under ``notes``.
    """
    more = {k: v for k, v in values.items() if k not in FIELDS}
    note = ", ".join([*filter(None, [values.get("notes")]), *(f"{k}: {v}" for k, v in sorted(more.items()))])
    entry = {**{k: values[k] for k in FIELDS if values.get(k) is not None}, "notes": note}
    entry.setdefault("date", str(datetime.date.today()))
    row = [(time.time_ns(), *(str(entry[k]) if k in entry else None for k in FIELDS))]
    spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").json(folder)


def set_leaderboard(spark: SparkSession, folder: str, run_id: str, value: float) -> None:
    """Record the leaderboard's score of a run: an entry of its own, which read_log lays over the others."""
    spark.createDataFrame([(time.time_ns(), run_id, str(value))], "logged_at bigint, run_id string, leaderboard string").coalesce(1).write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run with the columns of the log: of each the value that was logged last."""
    entries = spark.read.schema(LOG).json(folder)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("logged_at"))).alias(c) for c in FIELDS if c != "run_id"]
    return entries.groupBy("run_id").agg(*last).select(*FIELDS)


def write_log_csv(log: DataFrame, folder: str) -> None:
    """The log as one CSV file with a header."""
    log.select(*FIELDS).coalesce(1).sortWithinPartitions("date", "run_id").write.mode("overwrite").option("header", True).csv(folder)


def correlation(log: DataFrame) -> DataFrame:
    """One row (``n``, ``pearson``, ``spearman``, ``verdict``) of (``run_id``, ``dev_official``, ``leaderboard``).

    Ranks are ordinal, ties by run. Fewer than three runs have no correlation.
    """
    rows = log.select("run_id", F.expr("try_cast(dev_official as double)").alias("x"), F.expr("try_cast(leaderboard as double)").alias("y")).dropna()
    place = lambda c: F.row_number().over(Window.orderBy(c, "run_id")).cast("double")  # noqa: E731  the log is small
    rows = rows.withColumn("rx", place("x")).withColumn("ry", place("y"))
    made = rows.agg(F.count("*").alias("n"), F.corr("x", "y").alias("p"), F.corr("rx", "ry").alias("s"))
    enough = F.col("n") >= 3
    s = F.col("s")
    return made.select(
        "n", F.when(enough, F.round("p", 6)).alias("pearson"), F.when(enough, F.round(s, 6)).alias("spearman"),
        F.when(~enough, "too few").when(s >= 0.8, "healthy").when(s >= 0.5, "suspect").otherwise("broken").alias("verdict"),
    )


def merged(base: object, over: object) -> object:
    """Two parsed trees laid over each other: mappings key by key, anything else by the second."""
    if not isinstance(base, dict) or not isinstance(over, dict):
        return over
    return {k: merged(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in {**base, **over}}


def _tree(assignment: str) -> dict:
    """``a.b=1`` as the tree {a: {b: 1}}; a value that is no JSON is text."""
    path, value = assignment.split("=", 1)
    try:
        leaf: object = json.loads(value)
    except ValueError:
        leaf = value
    return reduce(lambda inner, name: {name: inner}, reversed(path.split(".")), leaf)


def load_config(path: str, overrides: tuple[str, ...] | list[str] = ()) -> dict:
    """A JSON configuration (YAML where a parser is installed) with ``a.b=value`` trees laid over it."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            config = yaml.safe_load(f)
        else:
            config = json.load(f)
    return reduce(merged, map(_tree, overrides), config)


def config_digest(config: dict) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:8]


def run_id(prefix: str, config: dict, day: datetime.date | None = None) -> str:
    return f"{prefix}-{(day or datetime.date.today()):%m%d}-{config_digest(config)}"


@dataclass(frozen=True)
class Model:
    name: str
    params: int
    max_tokens: int
    segmented: bool = False
    approved: bool = True
    query_prefix: str = ""
    doc_prefix: str = ""


class Registry(dict):
    """Models by name; an unknown or unapproved one is refused."""

    def add(self, model: Model) -> None:
        self[model.name] = model

    def approved(self, name: str) -> Model:
        model = self[name]
        if not model.approved:
            raise ValueError(f"{name!r} is not approved")
        return model

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([m.__dict__ for m in self.values()], "name string, params long, max_tokens int, segmented boolean, approved boolean, query_prefix string, doc_prefix string")


def parameter_budget(components: list[tuple[str, str]], registry: Registry, ceiling: int = PARAMETER_CEILING) -> dict:
    total = sum(registry[name].params for _, name in components)
    return {"components": [(role, name, registry[name].params) for role, name in components], "total": total, "headroom": ceiling - total, "ok": total < ceiling}


def environment(spark: SparkSession) -> dict:
    return {"python": platform.python_version(), "spark": spark.version, "java": spark.sparkContext._jvm.System.getProperty("java.version")}


def freeze(path: str, spark: SparkSession, config: dict, stages: list[str]) -> dict:
    made = {"environment": environment(spark), "config": config, "digest": config_digest(config), "stages": stages}
    with open(path, "w", encoding="utf-8") as out:
        json.dump(made, out, ensure_ascii=False, indent=1, sort_keys=True)
    return made


def replay(path: str, spark: SparkSession, steps: dict[str, Callable[[dict], object]], allow_drift: bool = False) -> list:
    """Run the frozen stages in order, by name; refuses an environment that has drifted."""
    with open(path, encoding="utf-8") as f:
        frozen = json.load(f)
    drift = {k for k, v in environment(spark).items() if frozen["environment"].get(k) != v}
    if frozen["digest"] != config_digest(frozen["config"]) or (drift and not allow_drift):
        raise RuntimeError(f"the frozen pipeline does not fit: {sorted(drift) or 'its configuration was changed'}")
    return [steps[name](frozen["config"]) for name in frozen["stages"]]
