"""A training corpus from the documents table: filter, deduplicate, decontaminate, mix.

Each stage works on all that the one before it kept; between stages the documents are written to the
shared folder and read again, so a lost executor repeats one stage at most. All but the last stage
return the columns of the documents they were given.
"""

from pyspark.sql import functions as F

from voxstars.llm import decontamination, mixing, repeats, resampling, simhash
from voxstars.sources.staging import stage


def _with_row(docs):
    """Id and text, and the whole row in one column that no operator looks into."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def quality_classifier(spark, docs, sf_dir):
    """Documents that the quality model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resampling.resample(_with_row(docs), labels).select("_row.*")


def _with_place(docs):
    """Id, text and source, the whole row in one column, and the row's own place: file and line.

    The place tells rows apart whose ids repeat or are missing. A plain scan of Parquet files, which
    the stages are given, has it already; any other table is written first.
    """
    plain = docs._jdf.queryExecution().analyzed().toString().startswith("Relation [")
    rows = docs if plain else stage(docs)
    whole = F.struct(*[rows[c] for c in docs.columns]).alias("_row")
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line")
    return rows.select(rows["doc_id"], rows["text"], rows["source"], whole, *place)


def simhash_near_dedup(spark, docs, sf_dir):
    """Of every component of near-duplicates the document with the smallest id stays.

    Documents without an id stay; rows of the component with the id that stays are that document. Of
    rows that share an id, only those go whose own component has a smaller id. Fingerprints are
    computed once and kept with the rows' places.
    """
    rows = _with_place(docs)
    marked = stage(rows.select("doc_id", simhash.fingerprint(F.col("text"), size=3).alias("fp"), "file", "line"))
    found = simhash.group_fingerprints(marked.select("doc_id", "fp"), bits=2)
    gone = found.filter("doc_id <> component_id").select("doc_id", "fp").distinct()
    places = marked.join(gone, ["doc_id", "fp"]).select("file", "line")
    return rows.join(places, ["file", "line"], "left_anti").select("_row.*")


def suffix_array_dedup(spark, docs, sf_dir):
    """Strings of 50 bytes that an earlier document has are cut out of the text."""
    cut = repeats.remove_repeats(_with_row(docs), carry=("doc_id", "text", "_row"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents with a benchmark passage go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark, docs, sf_dir):
    """The documents that the mix takes words of, with their size, target and words taken.

    Rows are told apart by their place, so that rows with equal or missing ids keep their own figures.
    """
    rows = _with_place(docs)
    mixed = mixing.mix(rows.select("doc_id", "source", "text", "file", "line"), carry=("file", "line"))
    taken = mixed.filter("taken > 0").select(
        "file", "line", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), F.col("taken").alias("mix_taken"),
    )
    figures = [c for c in taken.columns if c.startswith("mix_")]
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in figures]
    return rows.join(taken, ["file", "line"]).select(*own, *figures)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
]

ORACLE_SQL = None  # no stage but the last could be put into SQL


def run(spark, sf_dir):
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs if i == 0 else stage(docs), sf_dir)
    return docs
