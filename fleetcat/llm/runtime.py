"""Session helpers of the operators: shipping the package, lineage cuts, Arrow column access."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fleetcat.session import cut_lineage, ensure_checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a checkout (a cluster installs it or uses --py-files)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
        env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # one allocator per worker, which gives memory back
        env.setdefault("MALLOC_ARENA_MAX", "2")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: computed once, and no lost executor undoes them."""
    return cut_lineage(df, f"llm-{name}")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder (URI or path) below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


_kept: dict = {}  # what the tasks of one operator share in a worker


def worker_object(key, make: Callable):
    """An object that a worker keeps for the next tasks of the same operator; other keys are let go."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task and run the next operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _task(batches: Iterator[pa.RecordBatch], fn: Callable, keep: bool) -> Iterator[pa.RecordBatch]:
    if not keep:
        _kept.clear()
    try:
        yield from fn(batches)
    finally:
        give_back()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: bool = False) -> DataFrame:
    """``df.mapInArrow`` whose tasks leave nothing in their worker (``keep``: but for ``worker_object``)."""
    prepare(df.sparkSession)
    return df.mapInArrow(partial(_task, fn=fn, keep=keep), schema)
