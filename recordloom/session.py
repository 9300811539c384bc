"""Session settings and the durable cut points of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key keeps its last value, as it does in the JSON reader that
    # produced the records.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Ids of two weeks and counts per request stay on local disk, not on the heap;
    # a batch uploads what it changed.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: Folders made inside ``scratch``, one list per block that is open.
_SCRATCH: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    A folder on this machine is only acceptable when the whole session lives on
    this machine, so a cluster without ``spark.checkpoint.dir`` is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.conf.get("spark.master", "").split("[")[0] == "local"
    if folder:
        return folder
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="recordloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh location under the shared folder."""
    folder = f"{shared_folder(spark)}/recordloom/{label}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are removed when it ends: a stream must not
    leave some behind with every batch. Whatever is read from them has to be
    written before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _SCRATCH.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: the lineage ends at stored files, so
    a lost executor never makes an upstream step run again."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
