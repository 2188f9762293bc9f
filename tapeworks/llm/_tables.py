"""Row plumbing that the operators share: scans of texts in Arrow batches, shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import _words


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one machine (tests) sets a
    temporary one, and a cluster raises."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tapeworks-")
        spark.conf.set("spark.checkpoint.dir", known)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str = "cut") -> DataFrame:
    """Written to the shared folder and read back: a cut of the lineage that outlives executors."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    _paths[out] = path
    return out


_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def discard(*frames: DataFrame | None) -> None:
    """Delete what stored() wrote for frames that nothing reads any more."""
    for frame in frames:
        path = None if frame is None else _paths.pop(frame, None)
        if path is not None:
            jvm = frame.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def rename(held: DataFrame, by: DataFrame) -> None:
    """``by`` is now the frame whose discard() deletes what ``held`` was stored as."""
    _paths[by] = _paths.pop(held)


def trim() -> None:
    """Give what this process has freed back to the machine: large arrays leave holes behind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted now: Spark does it once the driver's
    collector has found their frames unreachable, which may be long after."""
    trim()
    spark.sparkContext._jvm.System.gc()


def release_memory(spark: SparkSession) -> None:
    """release_shuffles(), and executors collect their garbage too: a JVM's heap grows with each step
    and gives nothing back before a full collection, which rows that die young never bring about.
    A task for each core; an executor that gets none keeps what it has."""
    release_shuffles(spark)
    if not spark.sparkContext._jsc.sc().isLocal():
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()  # n rows


#: Rows of an Arrow batch: texts may be long, and a batch is held several times over.
BATCH_ROWS = "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run):
    """``run`` for mapInArrow, in a worker that gives freed memory back: large arrays are mapped
    and unmapped one by one, and at the end nothing freed is kept for an idle worker."""

    def wrapped(batches):
        libc = None
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                gc.collect()
                libc.malloc_trim(0)

    return wrapped


def shielded(reserved: str = "__"):
    """For operators (frame, ...) -> frame that name their own columns with ``reserved`` in front:
    such columns of the input have another name inside and their own again in the result."""

    def around(operator):
        @functools.wraps(operator)
        def run(frame: DataFrame, *args, **kwargs):
            mine = [c for c in frame.columns if c.startswith(reserved) and c not in [*args, *kwargs.values()]]
            if not mine:
                return operator(frame, *args, **kwargs)
            stem = "own"
            while any(c.startswith(stem) for c in frame.columns):
                stem += "_"
            inside = {c: f"{stem}{k}" for k, c in enumerate(mine)}
            out = operator(frame.withColumnsRenamed(inside), *args, **kwargs)
            return out.withColumnsRenamed({v: k for k, v in inside.items()})

        return run

    return around


def scan_texts(
    frame: DataFrame,
    text: str,
    fields: Iterable[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    keep: list[str] | None = None,
    limit: int = 1 << 20,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``frame`` new columns, found from slices of bounded text size.

    ``make`` runs once in a task and gives a function from a slice to the new columns (by
    name; Arrow arrays, one value a row). With the key ``None`` the function gives a list of
    kept row numbers instead of all. Columns of ``frame`` in ``keep`` (None: all) stay, but
    one whose name a new column has is replaced; those in ``also`` are read besides.
    """
    fields = list(fields)
    new = {f.name for f in fields}
    kept = [c for c in (frame.columns if keep is None else keep) if c not in new]
    schema = T.StructType([frame.schema[c] for c in kept] + fields)

    def run(batches):
        kernel = make()
        for batch in batches:
            for part in _words.pieces(batch, text, limit):
                out = kernel(part)
                rows = out.pop(None, None)
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                if rows is not None:
                    columns = [c.take(pa.array(rows, pa.int64())) for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, *(out[f.name] for f in fields)], names=[*kept, *(f.name for f in fields)])

    needed = list(dict.fromkeys([*kept, text, *also]))
    order = list(dict.fromkeys([*(frame.columns if keep is None else keep), *(f.name for f in fields)]))
    out = frame.select(*[f"`{c}`" for c in needed]).mapInArrow(lean(run), schema)
    return out if order == out.columns else out.select(*[f"`{c}`" for c in order])
