"""Marks of possible copies stay sharp when many reviews have copies."""

from pyspark.sql import functions as F

from voxstars.operators import prepare as P


def test_few_rows_without_a_copy_are_suspected(spark):
    """Sixty values with copies in sixteen cells, as 4 million in the cells of a large table; one bit each marked some 6 % of the others."""
    copied = spark.range(60).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    alone = spark.range(1000, 6000).withColumn("n", F.lit(1))
    marked = P.suspected_copies(copied.unionByName(alone), ["id"], cell_bits=4)
    assert marked.columns == ["id", "n", "_suspect"]
    assert marked.filter("id < 60 AND _suspect").count() == 120
    assert marked.filter("id >= 1000 AND _suspect").count() < 0.025 * 5000
