"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# A side is shipped whole to every task only below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(master: str | None = None, app: str = "scholarweave", **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    Nothing here is sized for one machine except what the caller passes in: the
    number of shuffle partitions is left to adaptive execution on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder that the cluster names. Without one, a local session gets a folder in its warehouse; on a cluster that must be a shared store."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if shared:
        context.setCheckpointDir(shared)
        return
    own = context._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"), f"_checkpoints-{uuid.uuid4().hex}")
    files = own.getFileSystem(context._jsc.hadoopConfiguration())
    if files.getScheme() == "file" and not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    files.deleteOnExit(own)
    context.setCheckpointDir(own.toString())


def rounds(limit: int | None = None) -> Iterator[int]:
    """0, 1, 2, ... for a loop that ends itself. A loop not done after ``limit`` rounds fails: half a result is none."""
    at = 0
    while limit is None or at < limit:
        yield at
        at += 1
    raise RuntimeError(f"not finished after {limit} rounds")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the cluster's checkpoint folder and read it from there.

    Used where a result is read more than once and must not be computed differently
    the second time (sampled range bounds), and between rounds of a loop. The table is in
    replicated storage, so it outlives the executors that wrote it. Its lineage is forgotten and so are the
    estimates of its size: joins of the next round are planned on what was written, and only the columns they need are read.
    """
    spark = df.sparkSession
    path = scratch(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame | None) -> None:
    """Delete the tables of ``durable`` frames that a loop has left behind; nothing may read them any more."""
    for df in frames:
        if df is None:
            continue
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("stage-"):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables and stream progress of one run."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
