"""Session helpers."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import weakref
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: weakref.WeakSet = weakref.WeakSet()


def plain_unions(spark: SparkSession) -> None:
    """Keep unions from claiming the partitioning of their sides.

    In Spark 4.1 a union of sides that are dealt alike claims to be dealt so too; where adaptive execution then merges partitions of the
    sides differently, a join above it fails ("Can't zip RDDs with unequal numbers of partitions").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, unless they find it by PYTHONPATH."""
    sc = spark.sparkContext
    on_path = any(Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    if on_path or sc in _shipped:
        return
    base = Path(tempfile.mkdtemp(prefix="inkwell-ship-")) / "inkwell"
    staged = base.parent / "src"
    shutil.copytree(ROOT / "inkwell", staged / "inkwell", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(base), "zip", staged))
    _shipped.add(sc)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the executors first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        plain_unions(spark)
        return query(spark, sf_dir)

    return run
