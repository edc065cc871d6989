"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "ridgeline", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    conf = {
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, a local session gets a temporary
    folder; a cluster, whose executors could not read one, gets a RuntimeError.  Files are removed when the frame is no
    longer referenced, if the session sets ``spark.cleaner.referenceTracking.cleanCheckpoints``, as local ones do.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ridgeline-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` laid out by ``keys`` over four tasks a core, for groups that are small in bytes and long in computing.

    A stated number of partitions is not coalesced by size, so such groups don't end in one task.
    """
    return df.repartition(min(10_000, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)
