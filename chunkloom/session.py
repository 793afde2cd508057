"""Session helpers shared by tests, the bench and the entry point."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g", name: str = "chunkloom") -> SparkSession:
    """A local session with the settings that the engine expects: UTC, AQE, no UI; its tables, often of one row group, are dealt over ``partitions``."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config(PARTITIONS, str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: A setting of the caller's: partitions that tables are dealt over after reading. Unset, as on a cluster, partitions are those of the scan.
PARTITIONS = "spark.chunkloom.input.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path that Spark can read will do. Filters and columns reach the scan in any case."""
    df, parts = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.conf.get(PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def stored(df: DataFrame) -> DataFrame:
    """Made once, in the folder of ``spark.checkpoint.dir``: for rows that a model wrote, which a second reading mustn't ask for again.

    Where no folder is set, a local session (tests) gets one of its own; a cluster gets an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()
