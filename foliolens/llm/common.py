"""What the operators of this subpackage share: inputs, checkpoints, Arrow mapping, the label split."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from foliolens.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark opens the path, so any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a temporary folder takes its place in a local session (tests);
    on a cluster that is an error, as executors could not read it.
    """
    ship(spark)
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or getattr(context, "_foliolens_dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = context._foliolens_dir = tempfile.mkdtemp(prefix="foliolens-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a table in the shared folder, which survives lost executors."""
    return written(df, "state")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a Parquet table in the shared folder and read it again: compressed, and read by column."""
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``written`` and the table's path, for ``removed``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def _tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that this context wrote and has not removed, in order."""
    if not hasattr(spark.sparkContext, "_foliolens_tables"):
        spark.sparkContext._foliolens_tables = []
    return spark.sparkContext._foliolens_tables


def mark(spark: SparkSession) -> int:
    """A place in the order of written tables, for ``clear``."""
    return len(_tables(spark))


def clear(spark: SparkSession, since: int = 0, but: Collection[str] = ()) -> None:
    """Delete the tables written since a mark, but for those named.

    A result is read from such tables when it is used: clear after its last use (or
    after writing it elsewhere).
    """
    for path in _tables(spark)[since:]:
        if path not in but:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _tables(spark):
        _tables(spark).remove(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; batches without rows are left out."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hash_fraction(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the values: bounded samples take the rows below a threshold."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a column set; one of that name is replaced."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    if name in names:
        arrays[names.index(name)] = values
    else:
        names.append(name)
        arrays.append(values)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def with_fields(schema: StructType, *fields: tuple[str, str]) -> StructType:
    """The schema with columns added; the given schema stays as it is."""
    out = StructType(list(schema.fields))
    for name, kind in fields:
        out = out.add(name, DataType.fromDDL(kind))
    return out
