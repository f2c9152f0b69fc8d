"""Spreading small scans, and joins that broadcast only what was measured to be small."""

from pyspark.sql import functions as F

from voxstars.sources.staging import stage

MAX_ROWS = 1_000_000
MAX_BYTES = 64 << 20
SALTS = 32


def spread(df):
    """Use all cores when the scan has fewer partitions than the session has cores.

    A large table has many more partitions than cores and passes through unchanged; a single small
    file would otherwise run everything behind it in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df, max_rows=MAX_ROWS, max_bytes=MAX_BYTES):
    """Measure a table, reading no further than just past the row bound."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def salted_join(left, right, key, how, spread_by, salts=SALTS):
    """Equi-join in which a key that fills much of the left side is split over many tasks.

    The right side must be unique on the key; each of its rows is repeated once per salt.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(repeated, [key, "_salt"], how).drop("_salt")


def lookup_join(left, lookup, key, spread_by):
    """Left join with a lookup table: broadcast when measured small, otherwise shuffled with salt.

    The lookup is written first, so measuring and joining read it instead of computing it twice. The
    second way asks for a merge join, since a planner's estimate must not undo the measurement.
    """
    lookup = stage(lookup)
    if is_small(lookup):
        return left.join(F.broadcast(lookup), key, "left")
    return salted_join(left, lookup.hint("merge"), key, "left", spread_by)
