"""What the operators of this subpackage share: reading tables, cutting lineage, and small footprints of tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, rows of it that are Python objects at one time, and bytes of a row group of a written table.
BATCH, ROWS, ROW_GROUP = 1_024, 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir.

    Only where that is unset in local mode, as in tests, a temporary folder takes its place; on a cluster it would
    be a folder of one machine, so that there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="helixlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Let the session hand Python workers at most BATCH rows at a time, since texts may be long and both sides hold a batch.

    The setting stays, since results are computed later; a smaller one that the user has made is kept.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH:
        spark.conf.set(setting, str(BATCH))


def saved(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and outlives any executor.

    Files have small row groups, which writers hold in memory.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a saved() table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def slices(batches: Iterator, rows: int = ROWS) -> Iterator:
    """Parts of Arrow batches or arrays; a batch is let go before the next one is asked for."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        del batch


def lists(values, offsets) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def release() -> None:
    """Give back the memory that a task has freed, since its worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Only some C libraries can.
        pass


#: Keys with more rows than this, and more than one in HOT_KEYS of all rows, are hot: there are HOT_KEYS of them at most.
HOT_ROWS, HOT_KEYS = 5_000, 10_000


def joined(rows: DataFrame, keyed: DataFrame, on: str, members: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed (one row for each key, with its number of rows in `members`), however the rows are spread over keys.

    Rows of hot keys meet a broadcast table, which holds HOT_KEYS keys at most, where they are; only the others are shuffled.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = keyed.filter(F.col(members) > most).drop(members)
    if not hot.head(1):
        return rows.join(keyed.drop(members), on, how)
    hot = saved(hot)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keyed.filter(F.col(members) <= most).drop(members), on, how)
    return rows.join(F.broadcast(hot), on).unionByName(cold)
