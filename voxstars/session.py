"""Session settings for local runs, and the shared folder that jobs may write to."""

import tempfile

from pyspark.sql import SparkSession


def local_session(cores="*", name="voxstars", **conf):
    """A local session for tests and the bench; on a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """Folder every executor can read: the one named in ``spark.checkpoint.dir``.

    Only when the session names none (local tests) is a fresh temporary folder made and
    written back to the session's settings, so that later calls agree on it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.conf.get("voxstars.shared.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="voxstars-")
    spark.conf.set("voxstars.shared.dir", made)
    return made
