"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "rastrum", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def partitions_of(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir, which all executors share, so
    what is written survives the loss of executors. Only a local master, where driver and executors are
    one process, takes a temporary folder if nothing is set; a cluster without the setting is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="rastrum-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt by its key, never sent to all tasks by way of the driver.

    Spark estimates a table by the file that it comes from, and a sequence that is exploded counts as one row: a map of
    millions of cells made from a thousand rows is taken for a few kilobytes and would be collected to be broadcast.
    """
    return df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """df with its columns computed once, whatever is done with them.

    The optimizer pushes a filter below the projections that make its columns and repeats their expressions for
    each use, which for chains of expressions over lambdas grows without end. It does not push one below a generator;
    this one gives each row again, in the JVM and without a shuffle.
    """
    named = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return df.select(F.inline(F.array(F.struct(*named))))
