"""Small tables for the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, block int, value string"


def make_docs(spark, rows):
    """Documents from (id, text) or (id, text, source), with columns whose names the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), -1, -2, -3, "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
