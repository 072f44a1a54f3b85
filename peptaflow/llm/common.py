"""Scratch tables in the cluster's shared folder, and small helpers used by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WRITTEN: list[tuple[SparkSession, str]] = []
_PINNED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="peptaflow-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes scratch tables that nothing will read any more."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        for entry in [e for e in _WRITTEN if e[1] == path]:
            _remove(*entry)
            _WRITTEN.remove(entry)


def pin(table: DataFrame) -> None:
    """Exempts a scratch table from ``release``; it goes at exit."""
    for entry in [e for e in _WRITTEN if e[1] == table._scratch_path]:
        _WRITTEN.remove(entry)
        _PINNED.append(entry)


def release(keep: int = 0) -> int:
    """Deletes every scratch table written after the first ``keep`` ones; returns how many are left.

    Results that are still unread depend on scratch tables, so call this only once they have been written."""
    while len(_WRITTEN) > keep:
        _remove(*_WRITTEN.pop())
    return len(_WRITTEN)


@atexit.register
def _at_exit() -> None:
    try:
        _WRITTEN.extend(_PINNED)
        release()
    except Exception:  # the JVM is gone already; the folder's owner cleans up
        _WRITTEN.clear()


def with_fields(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    """A copy of the schema with more fields."""
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])


def bounded_sample(df: DataFrame, most: int, key: str) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``key``, all rows if there are no more.

    A threshold on the hash first leaves about twice as many, so that no task or driver sees ``most`` rows of each partition."""
    n, whole = df.count(), 1 << 40
    u = F.pmod(F.xxhash64(key), F.lit(whole))
    near = df if n <= 2 * most else df.filter(u < whole * 2 * most // n)
    return near.orderBy(u, key).limit(most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
