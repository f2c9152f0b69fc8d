"""A review table derived from the order tables, for the checks and the bench.

Every line item becomes a review by its customer of its part; its text is one whole document, the
documents taken in turn, so the work grows with both tables. Every 50th order is reviewed twice
(equal rows under another Id); nulls and more helpful votes than votes are put in by order number.
"""

from pyspark.sql import functions as F

from voxstars.functions.sizing import spread


def reviews_from_tables(spark, folder):
    def table(name, *cols):
        return spark.read.parquet(f"{folder}/{name}.parquet").select(*cols)

    documents = table("documents", "doc_id", F.col("text").alias("doc_text"))
    n_docs = documents.agg(F.count(F.lit(1)).alias("n_docs"))
    lines = spread(
        table("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    ).crossJoin(F.broadcast(n_docs))  # one row
    joined = (
        lines.join(table("orders", "o_orderkey", "o_custkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
        .join(table("part", "p_partkey", "p_name", "p_size"), F.expr("l_partkey = p_partkey"))
        .join(documents, F.expr("doc_id = (l_orderkey * 8 + l_linenumber) % n_docs"))
        .withColumn("den", F.expr("CAST((l_suppkey + l_linenumber) % 8 AS BIGINT)"))
        .withColumn("x", F.expr("CAST((CAST(l_quantity AS BIGINT) + p_size) % 10 AS INT)"))
    )
    days = "datediff(CAST(o_orderdate AS DATE), DATE'1970-01-01')"
    reviews = joined.selectExpr(
        "((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 100000"
        " + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS Id",
        "concat('P', CAST(l_partkey AS STRING)) AS ProductId",
        "concat('U', CAST(o_custkey AS STRING)) AS UserId",
        "CASE WHEN l_orderkey % 500 = 0 THEN den + 1 ELSE (l_partkey + l_orderkey) % (den + 1) END"
        " AS HelpfulnessNumerator",
        "den AS HelpfulnessDenominator",
        "CASE WHEN l_orderkey % 107 = 0 THEN NULL WHEN x < 5 THEN 5 WHEN x < 7 THEN 4"
        " WHEN x = 7 THEN 3 WHEN x = 8 THEN 2 ELSE 1 END AS Score",
        f"CASE WHEN l_orderkey % 103 = 0 THEN NULL ELSE CAST({days} AS BIGINT) * 86400 END AS Time",
        "CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE p_name END AS Summary",
        "CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE doc_text END AS Text",
        "l_orderkey % 50 = 0 AS twice",
    )
    # The copies come from one pass over the joins: every 50th order emits two rows.
    copies = F.explode(
        F.when(F.col("twice"), F.array(F.lit(0), F.lit(10**18))).otherwise(F.array(F.lit(0).cast("bigint")))
    )
    return (
        reviews.select("*", copies.alias("shift"))
        .withColumn("Id", F.col("Id") + F.col("shift"))
        .drop("shift", "twice")
    )
