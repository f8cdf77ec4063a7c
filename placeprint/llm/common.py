"""What the operators of this subpackage share: written tables, connected components, bounds on workers' memory."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from placeprint.operators.graph import components
from placeprint.operators.joins import split_join
from placeprint.sources.shared import drop_written, new_path, written

__all__ = ["BATCH_BYTES", "WORD", "bounded_batches", "components", "drop_written", "free_name", "new_path", "split_join", "trim", "written"]

#: Words are runs of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes in one Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for this session, as rows may be long texts; a smaller bound of the user's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has or begins with (Spark compares names without case): also fit as a prefix."""
    name = f"__{name}"
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def trim() -> None:
    """Give what a task has freed back to the system at its end; its worker stays and may serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)
