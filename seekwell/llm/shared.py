"""Shared folder, written tables and small DataFrame helpers of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship  # noqa: F401  (operators take it from here)

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none (tests, a laptop) a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="seekwell-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
        _made.append((spark, found))
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/seekwell-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._seekwell_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_seekwell_path", None):
            remove(t.sparkSession, path)
            _made[:] = [m for m in _made if m[1] != path]


def sent_if_small(keys: DataFrame, most_rows: int = 1 << 21) -> DataFrame:
    """A written table of narrow keys, to be broadcast if its counted rows are at most ``most_rows`` (some tens of megabytes);
    else Spark joins it by shuffling."""
    return F.broadcast(keys) if keys.count() <= most_rows else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def group_of_row(column: str, parts) -> F.Column:
    """A salt below ``parts`` from a column's hash: the same row always gets the same one."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(7)), parts)
