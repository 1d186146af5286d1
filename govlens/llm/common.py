"""What the operators of this package share: table access, scratch tables, text batches."""

from __future__ import annotations

import ctypes
import functools
import os
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package's code to the workers, once per application.

    A cluster job would name it in --py-files; queries that are called from any folder
    cannot rely on that.
    """
    context = spark.sparkContext
    if getattr(context, "_govlens_code", False):
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="govlens-"), "govlens_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._govlens_code = True


BATCH_ROWS = 1000  # texts may be long, and each side of a worker's pipe holds some batches


def ready(spark: SparkSession) -> None:
    """Code and batches of a size for the workers; each query and stage asks for it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor sees.

    Only a local session without that setting gets a folder of this machine.
    """
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "govlens-scratch")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict[str, tuple[str, object]] = {}


def held(kind: str, token: str, make: Callable[[], object], most: int = 1) -> object:
    """This worker's model of a job, made once: what ``make`` gives for ``token``.

    Workers serve one job after another, so a model goes as soon as one of another kind, or
    more than ``most`` of its own, are asked for. Models of all operators never add up.
    """
    if token not in _HELD:
        for other in [t for t, (k, _) in _HELD.items() if k != kind]:
            del _HELD[other]
        while len(_HELD) >= most:
            del _HELD[next(iter(_HELD))]
        _HELD[token] = (kind, make())
    return _HELD[token][1]


def release() -> None:
    """Drop the model that this worker holds; for work that needs the memory and no model."""
    _HELD.clear()


def give_back() -> None:
    """Free memory of this worker goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable) -> Callable:
    """``work`` on batches; at its end the worker gives free memory back.

    Executors keep idle workers, more of them the shorter the tasks are, and each would keep
    the most it ever needed.
    """

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def fold(doc_id: Column | str, n: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``n``; null ids are fold 0 of ''."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % n


def slices(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``size`` bytes, at least one row each."""
    total = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + size, side="right")))
        yield lo, hi
        lo = hi


def text_runs(batch: pa.RecordBatch, column: str, size: int = 1 << 20):
    """Runs of a batch with about ``size`` bytes of text each: (sub-batch, texts as bytes).

    Null text is empty. A batch may hold many long texts, so only a run's worth of
    Python objects exists at a time.
    """
    text = batch.column(column).cast(pa.binary())
    lengths = np.asarray(pa.compute.binary_length(text).fill_null(0))
    for lo, hi in slices(lengths.astype(np.int64), size):
        yield batch.slice(lo, hi - lo), [t or b"" for t in text.slice(lo, hi - lo).to_pylist()]


def keep(batch: pa.RecordBatch, names: list[str], more: dict[str, object], types: dict[str, pa.DataType]):
    """A batch of the named columns of ``batch`` followed by new ones."""
    arrays = [batch.column(n) for n in names] + [
        v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in more.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *more])
