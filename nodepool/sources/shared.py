"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table is broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 500_000
#: Bytes a core below which a table is spread over all cores by a shuffle.
SPREAD_BYTES = 32 << 20

#: Rows of a narrow table that a task sorts or joins.
ROWS_A_TASK = 250_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a local session where that is unset (tests) a folder
    that goes at exit. A cluster must name one that its executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="nodepool-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: read back column by column, and safe
    from the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is so small that its files may have fewer row groups than
    there are cores; larger tables are read as their files are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def parted(df: DataFrame, rows: int, *keys: Column | str) -> DataFrame:
    """df of so many rows, in parts by keys of some ROWS_A_TASK each, where the session's number
    of shuffle partitions would make larger ones: what a task sorts doesn't grow with df."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def remove(df: DataFrame) -> None:
    """Removes a table that written() made; nothing may read it after."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """df with `name`: numbers from `first` on in the given order, which must be total. Rows are
    sorted in range partitions, which are numbered apart and set off by their sizes; no
    task sees all rows."""
    from pyspark.sql import Window

    parts = df.sparkSession.sparkContext.defaultParallelism
    rows = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "sorted")
    at, offsets = first, []
    for r in sorted(rows.groupBy("__part").count().collect()):
        offsets.append((r[0], at))
        at += r[1]
    base = rows.join(F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __base bigint")), "__part")
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + F.col("__base")
    return base.withColumn(name, nth.cast("bigint")).drop("__part", "__base")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to have at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
