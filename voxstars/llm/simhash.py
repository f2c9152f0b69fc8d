"""SimHash near-duplicates, paired through tables of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to many references: the zero fingerprint, one
reference per pair of neighbouring bits, and some pseudorandom ones. By the triangle inequality no
distance changes by more than the fingerprints' own. Two fingerprints that differ in at most b bits
differ in at most b groups of bit pairs, so with b + 2 groups or more they agree in all coordinates
of some choice of the other groups; rows that share such coordinates meet. Pairs are discarded by
their largest coordinate difference, and survivors verified. Coordinates that more than
``FULL`` fingerprints share are not paired: there every fingerprint is linked, exactly, to the
smallest one within one bit of each of its one-bit neighbours, which is linear in their number.

Cases: null and empty texts have fingerprint zero and are linked like any other; a null id never
names a component unless all its members are null; equal rows share a fingerprint and a component.
Other columns are not looked at, whatever their names. A text is hashed whole; a long one in
parts of about 1 MB that end between words, so that memory follows its longest word at most.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxstars.llm.graph import components
from voxstars.llm.texts import LOWER, SLICE, SPACE, slices, text_bytes
from voxstars.sources.staging import stage

FULL = 64
SEED = 42
RANDOM_REFERENCES = 16
#: Eight byte-wide counters of a byte's bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _word_hashes(parts, size):
    """Hashes of the shingles of a list of words; fewer words are one shingle."""
    import xxhash

    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = min(size, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - last].tolist(), ends[last:].tolist())]


def _bit_counts(hashes, first, n):
    """How often each bit is set, per run of ``n`` hashes from ``first`` on.

    Lanes hold up to 255, so sums are taken over runs of 255 hashes, then over the runs of a text.
    """
    per = -(-n // 255)
    run_first = np.r_[0, np.cumsum(per)[:-1]]
    inside = np.arange(per.sum()) - np.repeat(run_first, per)
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], np.repeat(first, per) + inside * 255, axis=0)
    return np.add.reduceat(lanes.view(np.uint8).astype(np.int64), run_first, axis=0)


def _long_fingerprint(data, size, part=SLICE):
    """Fingerprint of one long text, in parts that end between words; the last words of a part open the next."""
    n, bits, carry, begin = 0, np.zeros(64, np.int64), [], 0

    def count(words):
        hashes = np.array(_word_hashes(words, size), np.uint64)
        return len(hashes), _bit_counts(hashes, np.zeros(1, np.int64), np.array([len(hashes)]))[0]

    while begin < len(data):
        end = min(begin + part, len(data))
        while end < len(data):
            free = np.flatnonzero(SPACE[data[end : end + 65536]])
            if len(free):
                end += int(free[0])
                break
            end = min(end + 65536, len(data))
        words = carry + data[begin:end].tobytes().split()
        begin = end
        if len(words) >= size:
            more, set_bits = count(words)
            n, bits = n + more, bits + set_bits
            words = words[len(words) - size + 1 :]
        carry = words
    if not n and carry:
        n, bits = count(carry)
    return np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)


def fingerprints_of(data, offsets, size=3):
    """Fingerprints (uint64) of texts given as lower-case bytes: bits set in over half the hashes."""
    if len(offsets) == 2 and len(data) > 2 * SLICE:
        return _long_fingerprint(data, size)
    texts = [_word_hashes(data[a:b].tobytes().split(), size) for a, b in zip(offsets[:-1], offsets[1:])]  # split at exactly 20, 09-0D
    counts = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    hashes = np.fromiter(itertools.chain.from_iterable(texts), np.uint64, int(counts.sum()))
    n = counts[full]
    bits = _bit_counts(hashes, np.r_[0, np.cumsum(n)[:-1]], n)
    out[full] = np.packbits(bits * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(size):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            found = [fingerprints_of(LOWER[part], at, size) for _, part, at in slices(data, offsets)]
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat)], names=["doc_id", "fp"])

    return run


def fingerprint(text, size=3):
    """The fingerprint of a text column, as ``fingerprints`` has it."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        found = [fingerprints_of(LOWER[part], at, size) for _, part, at in slices(data, offsets)]
        return pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))

    return of(text)


def fingerprints(docs, size=3):
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprint_batches(size), "doc_id long, fp long")


def references(n_random=RANDOM_REFERENCES, seed=5):
    """The zero fingerprint, 32 pairs of neighbouring bits, and pseudorandom ones, as signed numbers."""
    pairs = [3 << (2 * i) for i in range(32)]
    noise = np.random.default_rng(seed).integers(0, 1 << 64, n_random, dtype=np.uint64).tolist()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [0, *map(signed, pairs), *map(signed, noise)]


def distance_table(fps):
    """Adds ``near``, the distances to all references."""
    return fps.withColumn("near", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("tinyint") for r in references()]))


def meeting_keys(table, bits, groups):
    """One row per fingerprint and choice of ``groups - bits`` groups of pair coordinates.

    The coordinate of a pair of bits is the number of its bits set, which the distances to zero and
    to the pair's reference give.
    """
    coordinate = [(F.col("near")[0] + 2 - F.col("near")[1 + i]) / 2 for i in range(32)]
    by_group = [coordinate[g::groups] for g in range(groups)]
    group_keys = F.array(*[F.xxhash64(F.lit(g), *[c.cast("int") for c in cs]) for g, cs in enumerate(by_group)])
    choices = list(itertools.combinations(range(groups), groups - bits))
    table = table.select("fp", F.slice("near", 34, RANDOM_REFERENCES).alias("far"), group_keys.alias("_groups"))
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("_groups")[g] for g in c]) for i, c in enumerate(choices)])
    return table.select("fp", "far", F.explode(keys).alias("key"))


def links(fps, bits=2, full=FULL):
    """Links (a, b) that connect exactly the distinct fingerprints at most ``bits`` bits apart."""
    n = fps.count()
    groups = bits + (2 if n < 10_000_000 else 4 if n < 1_000_000_000 else 6)
    rows = meeting_keys(distance_table(fps), bits, groups)
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stage(rows.join(shared, "key"))
    light = met.filter(F.col("n") <= full)
    left, right = light.select("key", F.col("fp").alias("a"), F.col("far").alias("fa")), light.select("key", F.col("fp").alias("b"), F.col("far").alias("fb"))
    gap = F.array_max(F.zip_with("fa", "fb", lambda x, y: F.abs(x - y)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, "key").filter(F.col("a") < F.col("b")).filter(gap <= bits).filter(near <= bits)
    heavy = met.filter(F.col("n") > full).select("fp").distinct()
    return pairs.select("a", "b").distinct().unionByName(_through_neighbours(heavy, bits))


def _through_neighbours(fps, bits):
    """Links of crowded fingerprints through shared neighbours: those within b bits share one b/2 bits away."""
    one = [F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)]]
    flips = F.array(*one)
    around = fps.select("fp", F.col("fp").alias("hub"))
    for _ in range((bits + 1) // 2):
        around = around.select("fp", F.explode(F.transform(flips, lambda x: F.col("hub").bitwiseXOR(x))).alias("hub")).distinct()
    if bits % 2:
        raise ValueError("crowded coordinates are linked through half the bits: bits must be even")
    least = around.groupBy("hub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return around.join(least, "hub").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def group_fingerprints(marked, bits=2):
    """doc_id, fp and component_id (the smallest id reached through links) of a written table (doc_id, fp)."""
    classes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fp"), bits))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(lowest, "root").select("fp", "component_id")
    return marked.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs, size=3, bits=2):
    """doc_id, fp and component_id of every document."""
    return group_fingerprints(stage(fingerprints(docs, size)), bits)
