"""Session settings that the operators rely on."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="inkprint-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a fitted table by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(made: Sequence[Callable[[], object]]) -> list:
    """Results of functions that run Spark jobs which don't wait for each other's; the first error goes through."""
    with ThreadPool(len(made)) as pool:
        return pool.map(lambda make: make(), made, chunksize=1)


def let_go(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and tables that nothing needs any more; it does so when the driver's memory is collected."""
    for _ in range(3):  # what one collection finds unused may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
