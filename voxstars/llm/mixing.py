"""Mix sources to target weights, with DataFrame functions only.

The words of each source form one stream that is cut into blocks of fixed length. Every slot of an
output shard draws its source, which makes the shard's counts a multinomial draw; the few slots that
a source drew beyond its quota go to the sources that fell short. The r-th slot of a source takes
block p(r), where p is a keyed permutation of the source's blocks, another for each round through
them, and blocks are joined to slots by their number. All draws are hashes of seed and position, so
a rerun or a lost task gives the same mix.

Cases: a null text has no words; a null source is a source of its own and comes last; documents
without words are returned and never taken; equal rows are told apart by their place in the stream;
an empty table gives an empty result.
Other columns are not looked at, whatever their names; texts are only counted. The table of sources, a
row each, is ordered and summed in one task: meant for up to some million sources, not for one a document.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 20
CELLS = 4096


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes, weights=(1, 2, 3), limit=3):
    """One row per source: number, weight, size, target and share of the total.

    Sources whose limit is reached at the smallest level stop there; with the rows sorted by that
    level the others' common level follows from running sums. The table has one row a source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(limit))).withColumn("level", F.expr("cap / weight"))
    order = Window.orderBy("level", "number")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("common", F.try_divide(
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    )).withColumn("capped", F.expr("level <= common"))
    shared = F.max(F.when(~F.col("capped"), F.col("common"))).over(everything)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(shared * F.col("weight"))).select(
        "number", "source", "weight", "source_size", "target"
    )


def quotas(sources, block_words):
    """Blocks of each source and slots that come nearest its target: whole rounds, then part of one."""
    rows = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rest = F.round((F.col("target") - F.col("whole") * F.col("source_size")) / F.lit(block_words)).cast("long")
    return rows.withColumn("quota", F.col("whole") * F.col("blocks") + F.least("blocks", rest)).drop("whole")


def streams(sizes, sources, chunk_rows=4096):
    """The place of each document's first word in its source's stream.

    Running sums are taken within chunks of documents and then over the chunks, so that no task has
    to hold a whole source.
    """
    rows = sizes.count()
    own = [c for c in sizes.columns if c not in ("source", "tokens")]
    chunk = F.pmod(F.xxhash64(*own), F.lit(max(1, -(-rows // chunk_rows))))
    numbers = sources.select("number", F.col("source").alias("_source"))
    docs = sizes.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("chunk", chunk)
    inside = Window.partitionBy("number", "chunk").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = docs.groupBy("number", "chunk").agg(F.sum("size").alias("chunk_size"))
    chunks = chunks.withColumn("offset", F.coalesce(F.sum("chunk_size").over(over), F.lit(0))).drop("chunk_size")
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return docs.join(chunks, ["number", "chunk"]).withColumn("start", F.expr("offset + inside")).drop("offset", "inside", "chunk")


def _locate(points, ranges, point, total):
    """Join each point in [0, total) to the range [lo, hi) that holds it, by equal cells of the line."""
    width = max(1, -(-total // CELLS))
    cells = ranges.filter("hi > lo").select(
        "*", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("_cell")
    )
    return (
        points.withColumn("_cell", F.expr(f"{point} div {width}"))
        .join(cells, "_cell")
        .filter(f"{point} >= lo AND {point} < hi")
        .drop("_cell", "lo", "hi")
    )


def _ranges(rows, by, size):
    """Lay rows end to end: lo and hi of each."""
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("lo", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("hi", F.col("lo") + F.col(size))


def draw(spark, sources, shard_slots=4096, seed=7):
    """Slots of the mix: shard, slot, source number and its rank among the source's slots."""
    total = int(sources.agg(F.sum("quota")).first()[0] or 0)
    slots = spark.range(total).select(
        F.col("id").alias("slot"),
        F.expr(f"id div {shard_slots}").alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("source"), F.col("id")), F.lit(max(1, total))).alias("point"),
    )
    lines = _ranges(sources.select("number", "quota"), "number", "quota").drop("quota")
    drawn = stage(_locate(slots, lines, "point", total).drop("point"))
    over = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "number").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(offsets, ["shard", "number"])
    ranked = ranked.select("shard", "slot", "number", F.expr("offset + inside").alias("rank"))

    # Slots beyond a source's quota, laid end to end, fill the places that other sources have free.
    have = counts.groupBy("number").agg(F.sum("n").alias("n"))
    quota = sources.select("number", "quota").join(have, "number", "left").fillna(0, ["n"])
    extra = _ranges(quota.withColumn("extra", F.expr("greatest(n - quota, 0)")), "number", "extra")
    free = _ranges(quota.withColumn("free", F.expr("greatest(quota - n, 0)")), "number", "free")
    surplus = int(extra.agg(F.sum("extra")).first()[0] or 0)
    placed = ranked.join(extra.select("number", "quota", "lo"), "number")
    moved = placed.filter("rank >= quota").select("shard", "slot", F.expr("lo + rank - quota").alias("point"))
    gaps = free.select("number", "lo", "hi", F.col("lo").alias("first"), "n")
    moved = _locate(moved, gaps, "point", surplus).select("shard", "slot", "number", F.expr("n + point - first").alias("rank"))
    return placed.filter("rank < quota").select("shard", "slot", "number", "rank").unionByName(moved)


def permuted(index, size, seed, *key):
    """A keyed permutation of [0, size): in each round a pair (x, k - x) changes places or not."""

    def step(x, r):
        other = F.pmod(F.xxhash64(F.lit(seed), F.lit("pair"), *key, r) - x, size)
        swap = F.xxhash64(F.lit(seed), F.lit("swap"), *key, r, F.greatest(x, other)).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index.cast("long"), step)


def plan_mix(spark, sources, shard_slots=4096, seed=7):
    """The block that each slot takes."""
    slots = draw(spark, sources, shard_slots, seed).join(sources.select("number", "blocks"), "number")
    turn = F.expr("rank div blocks")
    block = permuted(F.expr("rank % blocks"), F.col("blocks"), seed, F.col("number"), turn)
    return slots.select("shard", "slot", "number", block.alias("block"))


def pieces(placed, block_words):
    """The part of each block that each document fills."""
    cut = f"explode(sequence(start div {block_words}, (start + size - 1) div {block_words}))"
    rows = placed.filter("size > 0").select("*", F.expr(cut).alias("block"))
    return rows.withColumn("words", F.expr(f"least(start + size, (block + 1) * {block_words}) - greatest(start, block * {block_words})"))


def mix(docs, weights=(1, 2, 3), limit=3, block_words=128, shard_slots=4096, seed=7, carry=()):
    """One row per document: its size, its source's size and target, and the words the mix takes of it.

    ``carry`` names narrow columns that go along, such as the row's own place where ids repeat.
    """
    spark = docs.sparkSession
    sizes = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry))
    sources = stage(quotas(targets(sizes, weights, limit), block_words))
    placed = stage(streams(sizes, sources))
    times = plan_mix(spark, sources, shard_slots, seed).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    parts = pieces(placed, block_words).join(times, ["number", "block"], "left").fillna(0, ["times"])
    taken = parts.groupBy("number", "start", "doc_id", "size", *carry).agg(F.sum(F.expr("words * times")).alias("taken"))
    empty = placed.filter("size = 0").select("number", "start", "doc_id", "size", *carry, F.lit(0).cast("long").alias("taken"))
    known = sources.select("number", "source", "source_size", "target")
    return (
        taken.unionByName(empty).join(known, "number").select("doc_id", "source", "size", "source_size", "target", "taken", *carry)
    )


def block_texts(docs, weights=(1, 2, 3), limit=3, block_words=128, shard_slots=4096, seed=7):
    """The mix itself: shard, slot and the text of the block there, words joined by one space."""
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    sizes = docs.select("doc_id", "source", words.alias("tokens")).withColumn("size", F.size("tokens").cast("long"))
    sources = stage(quotas(targets(sizes.select("source", "size"), weights, limit), block_words))
    placed = streams(sizes, sources).filter("size > 0")
    blocks = F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")

    def part(block):
        first = F.greatest(F.col("start"), block * block_words)
        last = F.least(F.col("start") + F.col("size"), (block + 1) * block_words)
        inside = F.slice("tokens", (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
        return F.struct(block.alias("block"), F.array_join(inside, " ").alias("part"))

    # Parts are cut before rows are multiplied, so a long document is not copied once a block.
    cut = placed.select("number", "start", F.inline(F.transform(blocks, part)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), " ")
    texts = cut.groupBy("number", "block").agg(joined.alias("text"))
    return plan_mix(spark, sources, shard_slots, seed).join(texts, ["number", "block"]).select("shard", "slot", "number", "block", "text")
