"""Tables written to the folder that driver and executors share, to cut lineage so that lost executors cost no more than a step."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder of its own; a cluster session is an error.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/scanweave-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="scanweave-")
        atexit.register(shutil.rmtree, _local[app], True)
    return f"file://{_local[app]}"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder; it also tells the planner its real size.

    ``release`` asks the driver's JVM to collect garbage then, upon which Spark deletes the shuffle files that the table replaces; otherwise large
    ones may take disk until the driver happens to collect.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark, schema = df.sparkSession, df.schema
    del df
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Delete this session's tables. Only call it once no result that reads them is still to be computed."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
