"""What the operators share: picking columns, slicing Arrow batches, loop checkpoints."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes that one vectorised step takes at a time; a longer single text is a step of its own.
SLICE_BYTES = 1 << 20


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null becomes empty), under fixed names: no extra column can clash with the operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of a text column that take about ``limit`` bytes, so that a batch is never turned into Python objects whole."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def binaries(flat, offsets, kind: pa.DataType = pa.binary()) -> pa.Array:
    """An Arrow array of the byte ranges [offsets[i], offsets[i+1]) of ``flat``."""
    import numpy as np

    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared checkpoint folder; in local mode one is set where none is, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-millwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/millwright-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is written: what a batch of long texts takes is held by the JVM and by Python.
BATCH_ROWS = 1000


def written(df: DataFrame, *, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and any executor can read it again.

    Arrow batches are short while it is written; the session's own setting is put back at once.
    """
    path, conf, name = folder or shared_dir(df.sparkSession), df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(work):
    """``work``, a function over batches, giving memory back at its end: Python workers stay for the tasks of later stages."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a table that an operator has written and needs no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows are told apart by one of so many marks before they are shuffled; a set of marks is small enough to broadcast, whatever the input.
MARKS = 1 << 20


def near_ids(rows: DataFrame, wanted: DataFrame, column: str, of: str) -> DataFrame:
    """The ``rows`` whose ``column`` has the mark of one of ``wanted``'s ``of``: all that could join, and few others where few are wanted."""
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)).alias("_mark")
    marks = F.broadcast(wanted.select(mark(of)).distinct())
    return rows.withColumn("_mark", mark(column)).join(marks, "_mark", "left_semi").drop("_mark")


def runs(batches, key: str) -> Iterator[tuple[int, pa.Table]]:
    """(key, its rows) for each run of rows with an equal integer ``key``; the batches come sorted by it."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and keys[lo] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def extended(docs: DataFrame, inputs: dict, fields, work) -> DataFrame:
    """``docs`` with the columns ``fields`` (a StructType) added, replacing any of the same name.

    ``work`` gets an Arrow batch of the columns ``inputs`` (name to Column, a text or bytes first), some MB of it at a time, and gives
    the arrays of ``fields``.
    The other columns travel inside one struct, so their names cannot clash with anything.
    """
    from pyspark.sql import types as T

    new = {f.name.lower() for f in fields}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new], F.lit(0).alias("_")).alias("row"), *[c.alias(n) for n, c in inputs.items()])
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *fields])

    def run(batches):
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), 4 * SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([part.column("row"), *work(part)], schema.names)

    out = rows.mapInArrow(tidy(run), schema)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in new]
    return out.select(*kept, *[f.name for f in fields])
