"""Arrow functions that are made when first used: a type given as DDL needs a running session."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Of rows handed to a worker at once; else a batch has 10,000 rows, however long their texts, which JVM and worker hold several times.
BATCH_BYTES = "4m"


def small_batches() -> None:
    """Bounds the bytes of a batch in plans made from now on."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def lean(f: Callable) -> Callable:
    """f, which gives back what Arrow and the C library keep of the batch before: a worker stays for later stages, and many of them are there at once."""

    @functools.wraps(f)
    def run(*batch):
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim is not None:
            trim(0)
        return f(*batch)

    return run


def arrow(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column) -> Column:
            small_batches()
            return F.pandas_udf(lean(f), kind)(*columns)

        call.__doc__, call.python = f.__doc__, f
        return call

    return wrap


def once(x: Column) -> Column:
    """x, kept where it is computed: the optimizer copies no nondeterministic expression into the places that read it.

    For texts that cost much and are read several times, also by an Arrow function, whose inputs are computed apart.
    """
    return F.when(F.monotonically_increasing_id() >= 0, x)  # also of an x that is never null, which coalesce() would be reduced to
