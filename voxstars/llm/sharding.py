"""Shards of nearly equal bytes that keep equal texts together, by best-fit-decreasing bin packing.

A group is all rows with one text and cannot be divided. Groups by falling size enter the bin whose
remaining capacity is tightest, found in a balanced tree. Packing runs on two levels, so that no task
sees all groups: the small groups of each part of the table are packed into parcels of a fixed
capacity, a small fraction of a shard; parcels and large groups, whose number is bounded by shards x
PARCELS, are then packed into shards. The shards' capacity is the smallest, found by bisection, for
which the packing needs no more than the wanted number. A group of more than a fair share has a
shard of its own and the others share the rest evenly.

Equal texts are found by their SHA-256 and never shuffled. A digest that very many rows have is sent
to the rows; there are at most HOT of those. Slots are running counts over fixed pieces of a written
table, so that no task numbers a whole shard.

Cases: a null text has no bytes, and its rows form one group with the empty texts (CRC of no bytes,
0); equal rows and repeated or null ids are rows like others, one slot each; ties in size go by
digest. With fewer groups than shards some shards stay empty; an empty table gives no rows. Column
names of the documents other than id and text do not matter.
"""

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars.sources.staging import stage

PARCELS = 1024  # parcels that fill a shard
PART_GROUPS = 100_000  # groups that one task packs
HOT = 10_000
PIECE = 4096  # rows that are numbered together
LEAF = 256


class OpenBins:
    """(remaining capacity, bin) in order: a B+-tree of two levels, all leaves at one depth."""

    def __init__(self):
        self.leaves, self.least = [], []

    def add(self, entry):
        if not self.leaves:
            self.leaves, self.least = [[entry]], [entry]
            return
        at = max(0, bisect_left(self.least, entry) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        self.least[at] = leaf[0]
        if len(leaf) > 2 * LEAF:
            self.leaves[at : at + 1] = [leaf[:LEAF], leaf[LEAF:]]
            self.least[at : at + 1] = [leaf[0], leaf[LEAF]]

    def tightest(self, size):
        """Take out the entry of the smallest remaining capacity that ``size`` fits in, or None."""
        wanted = (size, -1)
        at = max(0, bisect_left(self.least, wanted) - 1)
        while at < len(self.leaves):
            leaf = self.leaves[at]
            i = bisect_left(leaf, wanted)
            if i < len(leaf):
                entry = leaf.pop(i)
                if leaf:
                    self.least[at] = leaf[0]
                else:
                    del self.leaves[at], self.least[at]
                return entry
            at += 1
        return None


def best_fit(sizes, capacity, most=None):
    """Bin of each size, sizes falling and none above the capacity; None when more than ``most`` bins are needed."""
    tree, bins, opened = OpenBins(), [], 0
    for size in sizes:
        entry = tree.tightest(size)
        if entry is None:
            if opened == most:
                return None
            entry = capacity, opened
            opened += 1
        left = entry[0] - size
        if left:
            tree.add((left, entry[1]))
        bins.append(entry[1])
    return bins


def pack(sizes, shards):
    """Bins of falling sizes in at most ``shards`` bins of the smallest capacity that bisection finds."""
    if not sizes:
        return []
    low = max(sizes[0], -(-sum(sizes) // shards))
    found = best_fit(sizes, low, shards)
    if found is not None:
        return found
    step = max(1, low >> 16)
    high = low + step
    while (found := best_fit(sizes, high, shards)) is None:
        low, step = high, 2 * step
        high += step
    grain = max(1, low >> 16)
    while high - low > grain:
        middle = (low + high) // 2
        tried = best_fit(sizes, middle, shards)
        if tried is None:
            low = middle
        else:
            high, found = middle, tried
    return found


def _parcels(capacity):
    """Best fit of one part's groups into parcels."""

    def run(table):
        sizes = table.column("bytes").to_numpy()
        digests = table.column("digest").combine_chunks()
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], digests[i].as_py()))
        found = np.empty(len(sizes), np.int64)
        found[order] = best_fit([int(sizes[i]) for i in order], capacity)
        return pa.table({"digest": digests, "part": table.column("part"), "parcel": found, "bytes": sizes, "copies": table.column("copies")})

    return run


def _alone(largest, total, shards):
    """How many of the largest groups have a shard of their own, and what is left for the others."""
    n = 0
    while n < len(largest) and shards - n > 1 and largest[n] * (shards - n) >= total:
        total -= largest[n]
        n += 1
    return n, total


def place_groups(groups, shards, parcels=PARCELS, part_groups=PART_GROUPS):
    """Shard of each group of a written table (digest, bytes, copies)."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    largest = groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()
    alone, rest = _alone([r["bytes"] for r in largest], total, shards)
    left = shards - alone
    capacity = max(1, rest // (left * parcels))
    own = [bytes(r["digest"]) for r in largest[:alone]]
    others = groups.filter(~F.col("digest").isin(own)) if own else groups
    # Above the parcels' capacity: at most left x parcels groups, plus the rounding of the capacity.
    large = others.filter(F.col("bytes") > capacity)
    small = others.filter(F.col("bytes") <= capacity)
    parts = max(1, -(-small.count() // part_groups))
    dealt = small.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))
    packed = stage(dealt.groupBy("part").applyInArrow(_parcels(capacity), "digest binary, part int, parcel long, bytes long, copies long"))
    made = packed.groupBy("part", "parcel").agg(F.sum("bytes").alias("bytes")).collect()  # at most 2 x left x parcels + parts
    items = [(-r["bytes"], 0, bytes(r["digest"])) for r in large.select("bytes", "digest").collect()]
    items += [(-r["bytes"], 1, (r["part"], r["parcel"])) for r in made]
    items.sort()
    bins = pack([-i[0] for i in items], left)
    of_digest = [(bytearray(d), n) for n, d in enumerate(own)]
    of_digest += [(bytearray(i[2]), b + alone) for i, b in zip(items, bins) if i[1] == 0]
    of_parcel = [(*i[2], b + alone) for i, b in zip(items, bins) if i[1] == 1]
    of_digest = F.broadcast(spark.createDataFrame(of_digest, "digest binary, shard int"))
    of_parcel = F.broadcast(spark.createDataFrame(of_parcel, "part int, parcel long, shard int"))
    out = ("digest", "copies", "shard")
    return groups.join(of_digest, "digest").select(*out).unionByName(packed.join(of_parcel, ["part", "parcel"]).select(*out))


def numbered(path_rows, group="shard"):
    """Gapless slots within each shard of a written table, from counts over pieces of its files."""
    place = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("line")
    rows = path_rows.select("*", *place).withColumn("piece", F.expr(f"line DIV {PIECE}"))
    key = [group, "file", "piece"]
    before = Window.partitionBy(group).orderBy("file", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
    starts = starts.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("line"))
    slot = (F.col("start") + F.col("inside") - 1).alias("slot")
    rows = rows.withColumn("inside", inside).join(starts, key)
    return rows.select(*path_rows.columns, slot)


def assign(docs, shards=24, doc_id="doc_id", text="text", extra=8, carry=(), parcels=PARCELS, part_groups=PART_GROUPS):
    """(doc_id, size, text_crc32, shard, slot) of every document; with ``carry`` its columns in ``row`` too."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    held = [F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []
    rows = stage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(content) + F.lit(extra)).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"), F.unhex(F.sha2(content, 256)).alias("digest"), *held,
    ))
    groups = stage(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")))
    n = rows.count()
    if not n:
        return rows.drop("digest").select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = stage(place_groups(groups, shards, parcels, part_groups))
    common = F.col("copies") > max(1, n // HOT)
    hot = placed.filter(common).select("digest", "shard")  # at most HOT rows
    rare = placed.filter(~common).select("digest", "shard")
    marked = rows.join(F.broadcast(hot), "digest", "left")
    found = marked.filter("shard IS NOT NULL").unionByName(marked.filter("shard IS NULL").drop("shard").join(rare, "digest"))
    return numbered(stage(found.drop("digest")))


def write_shards(docs, path, shards=24, **options):
    """Write the documents as Parquet, one folder a shard, with their slots; columns shard and slot are replaced."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = assign(docs, shards, carry=kept, **options).select("row.*", "shard", "slot")
    placed.repartition("shard", F.expr(f"slot DIV {PIECE * 16}")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
