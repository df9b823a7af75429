"""Tables kept under a key of what they were made from."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def source_digest(config: dict, paths: list[str]) -> str:
    """Digest of a configuration and of the names, sizes and times of the input files."""
    files = []
    for path in sorted(paths):
        inner = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs] if os.path.isdir(path) else [path]
        files += [(p, os.path.getsize(p), os.stat(p).st_mtime_ns) for p in sorted(inner)]
    return hashlib.sha1(json.dumps([config, files], sort_keys=True).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, name: str, config: dict, paths: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name``: read where its digest is there, else made, written and read."""
    at = f"{folder}/{name}-{source_digest(config, paths)}"
    if not os.path.exists(f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
