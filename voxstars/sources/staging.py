"""Tables that several jobs of one report share."""

import uuid

from voxstars.session import shared_folder


_made = {}  # paths handed out, by application


def shared_path(spark, name="staged"):
    """A new path in the folder that all executors share."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df, compression=None):
    """Write a table to the shared folder once and read it back.

    Large tables of text take half the room with ``compression="zstd"``. Jobs that follow start from files that outlive any executor, instead of repeating the plan.
    """
    path = shared_path(df.sparkSession)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark, path):
    """Delete a written table, once nothing reads it any more."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def drop_staged(spark):
    """Delete every table of this application's ``shared_path`` and ``stage`` calls; returns how many there were.

    For long-lived sessions, once the results that read them are written. Models and results that are
    still to be read must not depend on them.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop(spark, path)
    return len(paths)
