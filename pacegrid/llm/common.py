"""Shared plumbing: tables in the shared folder, size-checked broadcasts, row batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes up to which a join side may be broadcast.
BROADCAST_BYTES = 32_000_000

#: Bytes of text that one step of a Python kernel works on.
CHUNK_BYTES = 1_000_000


#: Rows of one Arrow batch between Spark and a kernel: texts may be long.
BATCH_ROWS = "1000"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; from here on the session hands kernels small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests) a temporary folder is made and remembered;
    on a cluster that is an error, for executors don't see the driver's folders.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.pacegrid.scratch", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="pacegrid-")
            spark.conf.set("spark.pacegrid.scratch", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, and what
    was computed survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more; what was computed from it must be
    written itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files of finished steps now: Spark removes them once the driver's garbage
    collector finds their frames unused, which may be much later than the disk can bear."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, and that column's name; written, so that
    numbers stay the same however often they are read. Ids may be null or repeat; these don't."""
    row = fresh(docs, "__row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def checked_broadcast(side: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` with a broadcast hint if its counted bytes stay within ``limit``; else as it is,
    and Spark shuffles both sides. ``side`` must be cheap to count (a written table)."""
    fixed = {"boolean": 1, "byte": 1, "short": 2, "int": 4, "integer": 4, "float": 4, "date": 4}
    open_ended = [f.name for f in side.schema.fields if f.dataType.typeName() in ("string", "binary")]
    width = 16 + sum(fixed.get(f.dataType.typeName(), 8) for f in side.schema.fields)
    longer = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c in open_ended]
    counted = side.agg(F.count("*"), *(x.alias(f"b{i}") for i, x in enumerate(longer))).first()
    return F.broadcast(side) if counted[0] * width + sum(counted[1:]) <= limit else side


#: Rows of one key from which on it isn't left to a shuffle.
HEAVY = 500


def join_by_weight(rows: DataFrame, side: DataFrame, by: list[str], weight: str, how: str) -> DataFrame:
    """``rows`` joined with a written ``side`` of unique keys, "inner" or "left". ``weight`` says how
    many rows a key has: those of heavy keys, of which there are few, stay where they are, and only
    the others are shuffled."""
    columns = [c for c in side.columns if c not in by]
    heavy = checked_broadcast(side.filter(F.col(weight) >= HEAVY))
    there = rows.join(heavy, by, "inner").select(*rows.columns, *columns)
    rest = rows.join(heavy.select(*by), by, "left_anti").join(side.filter(F.col(weight) < HEAVY), by, how)
    return there.unionByName(rest.select(*rows.columns, *columns))


def crc32_bucket(id_col: str, n: int):
    """crc32(id as text) mod n, the fold rule of the labelled operators."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text, one row at least."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_buffer(batch.column(batch.schema.get_field_index(column)))[1])
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_buffer(column: pa.Array):
    """(bytes as uint8, offsets) of a string column; nulls count as empty."""
    import numpy as np

    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def as_signed(values):
    """uint64 array as int64, Spark's long."""
    import numpy as np

    return values.view(np.int64)


def has(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
