"""Tables written to the cluster's shared folder in the middle of a plan: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent and the session runs on one machine (tests) a temporary folder of our own is used; on a
    cluster its executors would each write to their own disk, so that the setting is asked for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _own_roots[app], ignore_errors=True)
    return _own_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` and read it back.

    A task holds a row group at a time, when it writes and when it reads, and the writer looks at its size only after 100 rows.
    ``group_bytes`` is for tables with rows of megabytes: the size is looked at after each row, and groups end beyond so many bytes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    checked = {} if group_bytes is None else {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    df.write.option("compression", "zstd").options(**checked).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
