"""Spelling variants: near words by PartEnum signatures, and the common form behind each rare spelling.

A word's letters, the k-th occurrence of a letter being an element of its own, are a set and so a
binary vector. One inserted or deleted letter changes one element, one replaced letter two. Elements
are dealt into PARTS partitions by their hash: words of one length that are near agree on all
partitions but two at most, words whose lengths differ by one on all but one. So each word signs
every choice of the partitions left after taking two out (with its length), and after taking one out
(once with its own length, once as the longer word of a pair); an equi-join of equal signatures
meets every near pair, and the edit distance verifies it. Signatures that more than CROWDED words
share are signed again together with one half of the word's letters in order, the first or the last:
one edit leaves one of the halves as it is, so no pair is lost there either.

Texts are split into words as byte arrays; the CRC of all words of a slice advances together, byte
by byte. Words are counted per slice by 64-bit hash, then by Spark as strings.

Cases: a null text has no words; a null id counts as an empty one in ``<doc_id>:<word>``; repeated
rows are rows like others; a text of any length is cut between words; ties in count go to the
smaller word; an empty table gives no rows. Other columns are not looked at, whatever their names.
"""

import math
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxstars.llm.texts import LOWER, PRIME, SLICE, mixed, rows_of, runs, slices, text_bytes, token_hashes
from voxstars.sources.staging import stage

PARTS = 4
CROWDED = 64
LONG = 64  # bytes of a word from which its CRC is taken alone

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
LEAD = 0xC3  # first byte of U+00C0 to U+00FF


def _crc_table():
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def _letters(data):
    """Marks the bytes of letters, and those that open a letter of two bytes."""
    lead = data == LEAD
    return ASCII_LETTER[data] | lead | np.r_[False, lead[:-1]], lead


def _parts(data, offsets):
    """Slices of whole texts; a longer text is cut where a byte is no part of a letter."""
    for a, part, at in slices(data, offsets, SLICE):
        if len(at) > 2 or len(part) <= 2 * SLICE:
            yield a, part, at
            continue
        begin = 0
        while begin < len(part):
            end = min(begin + SLICE, len(part))
            while end < len(part):
                window = part[end : end + 65536]
                free = np.flatnonzero((window < 128) & ~ASCII_LETTER[window])
                if len(free):
                    end += int(free[0])
                    break
                end += len(window)
            yield a, part[begin:end], np.array([0, end - begin], np.int64)
            begin = end


def _crcs(data, starts, ends, states):
    """CRC-32 of every word, begun in its document's state."""
    size = ends - starts
    crc = states.copy()
    long = np.flatnonzero(size > LONG)
    for i in long.tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(~crc[i])) ^ 0xFFFFFFFF
    by_size = np.argsort(-np.where(size > LONG, 0, size), kind="stable")
    state, at = crc[by_size], starts[by_size]
    held = np.where(size > LONG, 0, size)[by_size]
    for j in range(int(held[0]) if len(held) else 0):
        n = int(np.searchsorted(-held, -j, "left"))  # words of more than j bytes
        state[:n] = CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    crc[by_size] = state
    return ~crc


def _counted(every, least):
    """(word, n) of each slice: runs of letters, one code point taken out where ``every`` divides the CRC."""

    def run(batches):
        for batch in batches:
            ids = ["" if i is None else i for i in batch.column(0).to_pylist()]
            states = np.array([~np.uint32(zlib.crc32(f"{i}:".encode())) for i in ids], np.uint32)
            data, offsets = text_bytes(batch.column(1))
            for a, part, at in _parts(data, offsets):
                part = LOWER[part]
                member, lead = _letters(part)
                starts, ends = runs(member, at)
                if not len(starts):
                    continue
                opened = np.r_[0, np.cumsum(lead)]
                points = ends - starts - (opened[ends] - opened[starts])
                crc = _crcs(part, starts, ends, states[a + rows_of(at, starts)])
                cut = crc % np.uint32(every) == 0
                words, counts = [], []
                keep = ~cut & (points >= least)
                starts_, ends_ = starts[keep], ends[keep]
                if len(starts_):
                    hashes = token_hashes(part, starts_, ends_)
                    order = np.argsort(hashes, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(hashes[order]) != 0])
                    counts = np.diff(np.r_[first, len(order)]).tolist()
                    whole = part.tobytes()
                    words = [whole[s:e] for s, e in zip(starts_[order[first]].tolist(), ends_[order[first]].tolist())]
                for i in np.flatnonzero(cut & (points > least)).tolist():
                    word = part[starts[i] : ends[i]].tobytes().decode()
                    gone = int(crc[i]) % len(word)
                    words.append((word[:gone] + word[gone + 1 :]).encode())
                    counts.append(1)
                if words:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array(counts, pa.int64())})

    return run


def word_counts(docs, doc_id="doc_id", text="text", every=199, least=6):
    """(word, n) over all texts, for words of at least ``least`` code points."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    found = rows.mapInArrow(_counted(every, least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _code_points(column):
    """Code points of words of the letters above, one byte each, and each word's bounds."""
    data, offsets = text_bytes(column)
    lead = data == LEAD
    points = np.where(np.r_[False, lead[:-1]], data + np.uint8(0x40), data)[~lead]
    return points, offsets - np.r_[0, np.cumsum(lead)][offsets]


def _partition_hashes(points, bounds, parts):
    """A hash of each word's elements in each partition."""
    size = np.diff(bounds)
    word = np.repeat(np.arange(len(size)), size)
    key = word * 256 + points
    key.sort()
    first = np.flatnonzero(np.r_[True, np.diff(key) != 0])
    occurrence = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    element = mixed(((key & 255) | (occurrence << 8)).astype(np.uint64) + PRIME)
    dealt = (element >> np.uint64(17)) % np.uint64(parts)
    out = np.empty((len(size), parts), np.uint64)
    for p in range(parts):
        held = np.add.reduceat(np.where(dealt == p, element, np.uint64(0)), bounds[:-1])
        out[:, p] = mixed(held + np.uint64(int(PRIME) * (p + 1) % (1 << 64)))
    return out


def _signed(parts, least):
    """Rows (sig, side, size, word, n): side 0 meets its own kind, side 1 (shorter) meets side 2 (longer)."""
    pairs = list(combinations(range(parts), 2))

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 8192):
                batch = whole.slice(a, 8192)
                points, bounds = _code_points(batch.column(0))
                size = np.diff(bounds)
                held = _partition_hashes(points, bounds, parts)
                total = held.sum(axis=1, dtype=np.uint64)
                tag = lambda kind, length: mixed((length.astype(np.uint64) << np.uint64(16)) + np.uint64(kind))
                every = np.arange(len(size))
                longer = np.flatnonzero(size > least)
                sigs, sides, sizes, rows = [], [], [], []

                def add(who, sig, side, length):
                    sigs.append(mixed(sig)), rows.append(who), sizes.append(length)
                    sides.append(np.full(len(who), side, np.int32))

                for k, (i, j) in enumerate(pairs):
                    add(every, total - held[:, i] - held[:, j] + tag(k, size), 0, size)
                for i in range(parts):
                    rest = total - held[:, i]
                    add(every, rest + tag(1000 + i, size), 1, size)
                    add(longer, rest[longer] + tag(1000 + i, size[longer] - 1), 2, size[longer] - 1)
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_pydict({
                    "sig": np.concatenate(sigs).view(np.int64), "side": np.concatenate(sides), "size": np.concatenate(sizes).astype(np.int32),
                    "word": batch.column(0).take(at), "n": batch.column(1).take(at),
                })

    return run


def _met(rows):
    """Pairs of rows with one signature that are of a kind to be near, from one shuffle that both sides read.

    The kinds are told by a sum over both sides, since a condition on one side would be moved below the
    shuffle and make two of it. A merge join streams the pairs of a signature.
    """
    other = rows.select(F.col("sig"), *[F.col(c).alias(f"other_{c}") for c in ("side", "size", "word", "n")])
    kind = F.col("side") * 3 + F.col("other_side")
    fits = ((kind == 0) & (F.col("word") < F.col("other_word"))) | (kind == 5)
    pairs = rows.join(other.hint("merge"), "sig").filter(fits & (F.abs(F.col("size") - F.col("other_size")) < 1))
    near = pairs.filter(F.levenshtein("word", "other_word", 1) == 1)
    return near.select("word", "n", F.col("other_word").alias("other"), F.col("other_n"))


def near_words(words, least=6, parts=PARTS, crowded=CROWDED):
    """(word, n, other, other_n) for every two words of a written table (word, n) at edit distance one, both ways."""
    signed = words.select("word", "n").mapInArrow(_signed(parts, least), "sig long, side int, size int, word string, n long")
    signed = signed.filter("sig IS NOT NULL")  # a join adds this to some branches; all must be alike to share one shuffle
    counted = signed.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("sig")))
    plain = counted.filter(F.col("held") <= crowded).drop("held")
    half = F.expr("size DIV 2")
    again = F.array(
        F.xxhash64("sig", F.lit("first"), F.expr("substring(word, 1, size DIV 2)")), F.xxhash64("sig", F.lit("last"), F.right("word", half))
    )
    halved = counted.filter(F.col("held") > crowded).select(F.explode(again).alias("sig"), "side", "size", "word", "n")
    found = _met(plain).unionByName(_met(halved)).distinct()
    names = ("word", "n", "other", "other_n")
    ways = [F.struct(*[F.col(c).alias(name) for c, name in zip(order, names)]) for order in (names, names[2:] + names[:2])]
    return found.select(F.inline(F.array(*ways)))


def _roots(forms):
    """(word, root) of words with a form: each round doubles the steps taken.

    A form is ``factor`` times as frequent as its word, so the highest count bounds the steps.
    """
    ups = stage(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), "n", "form_n"))
    ratio, most = ups.agg(F.min(F.expr("form_n / n")), F.expr("max(form_n) / min(n)")).first()
    steps = math.floor(math.log(most) / math.log(ratio) + 1e-9) if most else 1
    ups = ups.select("word", "root")
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        further = ups.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ups = stage(ups.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return ups


def group_spellings(docs, least=6, min_count=5, factor=5, every=199, **columns):
    """(word, form, root, n, n_near, form_n) of every word of at least ``least`` letters and ``min_count`` occurrences.

    The form is the most frequent near word, if it is ``factor`` times as frequent as the word.
    """
    if factor <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = stage(word_counts(docs, every=every, least=least, **columns).filter(F.col("n") >= min_count))
    near = near_words(words, least).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    common = -F.col("best.less") >= F.col("n") * factor
    forms = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
    ))
    roots = _roots(forms)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
