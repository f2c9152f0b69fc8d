"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts up to ``order`` is counted over all training documents: its deepest level
is the table of (context, byte) counts, and every shallower level follows from it by sums. A byte is
coded in its longest context; if it was never seen there, an escape (method D: half a count of each
distinct byte) leads to the next shorter one, where all bytes seen in the longer one are excluded,
and at last to a uniform choice among bytes never seen. A document ends with a sign of its own. With
the counts fixed, the code length of a byte depends on its context alone, so each distinct (context,
byte) of the corpus is evaluated once, next to all contexts that end alike, and sent to the chunks
of documents that need it. Neither the trie nor the vocabulary is ever held by one task.

Every task passes on the counts of its distinct contexts and words, packed by bucket (a hash of
them); buckets are summed. Documents are dealt into chunks of about ``chunk_bytes``; a task holds
one chunk's texts and the distinct contexts and words in it.

Cases: a null text is empty: its end sign is all there is to score; without any training document
every byte is equally likely; repeated rows are scored alike and counted as often as they occur.
Other columns are not looked at, whatever their names. A text is scored whole: one longer than a slice is a
slice of its own, with about thirty bytes of memory for each of its bytes.
"""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from voxstars.llm.texts import LOWER, mixed, slices, text_bytes, token_hashes
from voxstars.sources.staging import stage

ORDER = 5
START, END = 0xFF, 0xFE  # never part of UTF-8
ALPHABET = 243 + 1  # bytes that UTF-8 has, and the end
SLICE = 1 << 20
HEAVY = 2_000_000  # (context, byte) of one ending that a task evaluates together
MOST = 2_000_000  # distinct (context, byte) or words that a task counts before it passes them on
COUNTS = "bucket int, grams binary, counts binary, words binary, word_counts binary, texts long"
WANTED = "chunk int, bucket int, grams binary, words binary"
ANSWERS = "chunk int, grams binary, log_p binary, words binary, word_counts binary"


def gram_keys(data, offsets, order):
    """Keys of every (context, byte): the nearest context byte stands highest, the coded byte lowest.

    Also the place of each text's first key; a text of n bytes has n + 1 keys, the last for its end. The
    texts are laid out with their start and end signs, and each key is read as one number of eight bytes.
    """
    n = np.diff(offsets)
    width = n + order + 1
    first = np.r_[0, np.cumsum(width)[:-1]]
    padded = np.full(int(width.sum()) + 8, START, np.uint8)
    padded[np.arange(len(data)) + np.repeat(first + order - offsets[:-1], n)] = data
    padded[first + width - 1] = END
    place = np.r_[0, np.cumsum(n + 1)[:-1]]
    # A key begins with the farthest byte of its context, ``order`` bytes before the coded one.
    begins = np.arange(len(data) + len(n)) + np.repeat(first - place, n + 1)
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))[begins]
    bits = np.uint64(8 * order)
    keys = ((eight & np.uint64((1 << (8 * order)) - 1)) << np.uint64(8)) | ((eight >> bits) & np.uint64(255))
    return keys.view(np.int64), place


def _distinct(parts, order):
    """Distinct keys of several slices and how often training texts have them."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    place = np.argsort(keys)
    keys = keys[place]
    first = np.flatnonzero(_new(keys))
    return keys[first], np.add.reduceat(n[place].astype(np.int64), first)


def _distinct_of(keys, given):
    """The same for one slice: the flag rides in the key's lowest bit, so that a plain sort is enough."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    ordered = np.sort((keys << 1) | given)
    given, ordered = ordered & 1, ordered >> 1
    first = np.flatnonzero(_new(ordered))
    return ordered[first], np.add.reduceat(given, first)


def _new(ordered):
    """Marks the first of every run of equal keys."""
    mark = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=mark[1:])
    return mark


def _once(keys):
    """Distinct keys in order; a sort with a mask is many times faster than numpy's hash table for unique keys."""
    ordered = np.sort(keys)
    return ordered[_new(ordered)]


def _bucket(keys, buckets):
    return (mixed(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _word_buckets(words, buckets):
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    out = np.zeros(len(words), np.int64)
    a = 0
    while a < len(words):  # in runs of bounded length
        b = max(a + 1, int(np.searchsorted(end, end[a] + SLICE)))
        low = end[a] - size[a]
        hashes = token_hashes(data[low : end[b - 1]], end[a:b] - size[a:b] - low, end[a:b] - low)
        out[a:b] = (hashes % np.uint64(buckets)).astype(np.int64)
        a = b
    return out


def _by_bucket(keys, counts, words, word_counts, buckets):
    """(bucket, keys, counts, words, word counts) as bytes, for every bucket that has any. The keys ascend."""
    cell = _bucket(keys, buckets)
    # A stable sort leaves the keys of a bucket in order; of 16-bit numbers it is a radix sort.
    cell = cell.astype(np.uint16) if buckets <= 1 << 16 else cell
    order = np.argsort(cell, kind="stable")
    keys, counts, bounds = keys[order], counts[order], np.searchsorted(cell[order], np.arange(buckets + 1))
    word_cell = _word_buckets(words, buckets) if words else np.zeros(0, np.int64)
    word_order = np.argsort(word_cell, kind="stable")
    word_bounds = np.searchsorted(word_cell[word_order], np.arange(buckets + 1))
    for bucket in range(buckets):
        mine = word_order[word_bounds[bucket] : word_bounds[bucket + 1]]
        lo, hi = bounds[bucket], bounds[bucket + 1]
        if hi > lo or len(mine):
            held = b" ".join([words[i] for i in mine.tolist()])
            yield bucket, keys[lo:hi].tobytes(), counts[lo:hi].astype(np.uint32).tobytes(), held, word_counts[mine].astype(np.uint32).tobytes()


def _table(rows, schema):
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _counted(order, buckets):
    """What a task's training texts hold, and with count 0 what only its other texts hold."""

    def run(batches):
        parts, known, other, texts = [], Counter(), set(), 0

        def flush():
            nonlocal texts
            if not parts:
                return
            keys, n = _distinct(parts, order)
            words = [*known, *(w for w in other if w not in known)]
            counts = np.r_[np.fromiter(known.values(), np.int64, len(known)), np.zeros(len(words) - len(known), np.int64)]
            rows = [(*row, 0) for row in _by_bucket(keys, n, words, counts, buckets)] + [(0, b"", b"", b"", b"", texts)]
            parts.clear(), known.clear(), other.clear()
            texts = 0
            yield from _table(rows, COUNTS).to_batches()

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts += int(train.sum())
            for a, part, at in slices(data, offsets, SLICE):
                part = LOWER[part]
                keys, first = gram_keys(part, at, order)
                given = np.repeat(train[a : a + len(at) - 1], np.diff(np.r_[first, len(keys)]))
                parts.append(_distinct_of(keys, given))
                for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    words = part[lo:hi].tobytes().split()
                    known.update(words) if train[a + i] else other.update(words)
                if len(parts) >= 4:
                    parts[:] = [_distinct(parts, order)]
                if len(parts[0][0]) > MOST or len(known) + len(other) > MOST:
                    yield from flush()
        yield from flush()

    return run


def _split(words):
    return words.split(b" ") if words else []


def _totals(order):
    """Sums of one bucket: a row per (context, byte) and per word; the end of texts is the empty word."""

    def run(table):
        bucket = table.column("bucket")[0].as_py()
        load = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
        keys, n = _distinct([(load("grams", np.int64), load("counts", np.uint32))], order)
        words = Counter()
        for held, counts in zip(table.column("words").to_pylist(), table.column("word_counts").to_pylist()):
            for word, count in zip(_split(held), np.frombuffer(counts, np.uint32).tolist()):
                words[word] += count
        texts = sum(table.column("texts").to_pylist())
        if texts:
            words[b""] = texts
        none = pa.nulls(len(words), pa.int64())
        return pa.table({
            "bucket": pa.array(np.full(len(keys) + len(words), bucket, np.int32)),
            "gram": pa.chunked_array([pa.array(keys), none]),
            "word": pa.chunked_array([pa.nulls(len(keys), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string())]),
            "n": pa.array(np.r_[n, np.fromiter(words.values(), np.int64, len(words))]),
        })

    return run


def low_orders(totals, order):
    """Counts of byte pairs (at most 256 x 256) and of single bytes."""
    pairs = np.zeros((256, 256))
    rows = totals.groupBy(
        F.shiftright("gram", 8 * order).cast("int").alias("last"), F.col("gram").bitwiseAND(255).cast("int").alias("byte")
    ).agg(F.sum("n").alias("n"))
    for r in rows.filter("n > 0").collect():
        pairs[r["last"], r["byte"]] = r["n"]
    return pairs, pairs.sum(axis=0)


def _step(log_p, open_, n, total, distinct):
    """Code what was seen in this context and let the rest escape; ``total`` and ``distinct`` lack the excluded."""
    hit = open_ & (n > 0)
    log_p[hit] += np.log10((n[hit] - 0.5) / total[hit])
    miss = open_ & ~hit & (total > 0)
    log_p[miss] += np.log10(0.5 * distinct[miss] / total[miss])
    return open_ & ~hit


def _deep(keys, n, order, least):
    """Code what contexts of ``order`` down to ``least`` bytes hold: the logarithms so far, what is still open, and
    per context of the last step its distinct bytes and which keys they are. The keys hold all of these contexts."""
    symbol = keys & 255
    log_p, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    above = None  # per deeper context: distinct bytes, and which (context, byte) they are
    for depth in range(order, least - 1, -1):
        context = keys >> (8 * (order - depth) + 8)
        codes, code_at = np.unique((context << 8) | symbol, return_inverse=True)
        code_n = np.bincount(code_at, weights=n, minlength=len(codes))
        contexts, context_at = np.unique(codes >> 8, return_inverse=True)
        total = np.bincount(context_at, weights=code_n)
        distinct = np.bincount(context_at, weights=code_n > 0)
        own = context_at[code_at]
        if above is None:
            open_ = _step(log_p, open_, code_n[code_at], total[own], distinct[own])
        else:
            deep_distinct, deep_at, deep_codes, deep_context = above
            lost = np.bincount(deep_context, weights=code_n[code_at[deep_codes]], minlength=len(deep_distinct))
            open_ = _step(log_p, open_, code_n[code_at], total[own] - lost[deep_at], distinct[own] - deep_distinct[deep_at])
        # One key for each (context, byte) that was seen here, to find its count one level up.
        a_key = np.zeros(len(codes), np.int64)
        a_key[code_at] = np.arange(len(keys))
        seen = code_n > 0
        above = distinct, own, a_key[seen], context_at[seen]
    return log_p, open_, above


def evaluate(keys, n, pairs, singles, order):
    """log10 probability of each key, given the counts of all keys whose contexts end in the same two bytes."""
    symbol = keys & 255
    log_p, open_, (deep_distinct, deep_at, deep_codes, deep_context) = _deep(keys, n, order, 2)
    last = keys >> (8 * order)
    row = pairs[last]
    n_1, total, distinct = pairs[last, symbol], row.sum(axis=1), (row > 0).sum(axis=1)
    lost = np.bincount(deep_context, weights=n_1[deep_codes], minlength=len(deep_distinct))
    open_ = _step(log_p, open_, n_1, total - lost[deep_at], distinct - deep_distinct[deep_at])
    lost = (row > 0) @ singles
    seen = (singles > 0).sum()
    open_ = _step(log_p, open_, singles[symbol], singles.sum() - lost, seen - distinct)
    log_p[open_] -= math.log10(max(1, ALPHABET - seen))
    return log_p


def evaluate_part(keys, n, ending, pairs, singles, order):
    """The same for keys whose contexts end in the same three bytes, given ``ending``: how often each byte follows
    the last two of them in the whole corpus."""
    symbol = keys & 255
    log_p, open_, (deep_distinct, deep_at, deep_codes, deep_context) = _deep(keys, n, order, 3)
    lost = np.bincount(deep_context, weights=ending[symbol[deep_codes]], minlength=len(deep_distinct))
    distinct = (ending > 0).sum()
    open_ = _step(log_p, open_, ending[symbol], ending.sum() - lost[deep_at], distinct - deep_distinct[deep_at])
    same = lambda x: np.full(len(keys), float(x))
    row = pairs[keys[0] >> (8 * order)]
    open_ = _step(log_p, open_, row[symbol], same(row.sum() - row[ending > 0].sum()), same((row > 0).sum() - distinct))
    seen = (singles > 0).sum()
    open_ = _step(log_p, open_, singles[symbol], same(singles.sum() - singles[row > 0].sum()), same(seen - (row > 0).sum()))
    log_p[open_] -= math.log10(max(1, ALPHABET - seen))
    return log_p


def heavy_endings(totals, order, most=HEAVY):
    """Byte counts after each ending of two bytes that more than ``most`` (context, byte) share.

    At most 65,536 x 256 counts; endings so heavy are few: one for each ``most`` keys of the corpus.
    """
    ending = F.shiftright("gram", 8 * (order - 1))
    heavy = totals.groupBy(ending.alias("ending")).agg(F.count(F.lit(1)).alias("keys")).filter(F.col("keys") > most)
    found = {r["ending"]: np.zeros(256) for r in heavy.collect()}
    if found:
        rows = totals.select(ending.alias("ending"), F.col("gram").bitwiseAND(255).alias("byte"), "n").filter(F.col("ending").isin(list(found)))
        for r in rows.groupBy("ending", "byte").agg(F.sum("n").alias("n")).collect():
            found[r["ending"]][r["byte"]] = r["n"]
    return found


def _evaluated(pairs, singles, order, buckets, heavy):
    def run(table):
        keys, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        ending = heavy.get(int(keys[0]) >> (8 * (order - 1)))
        log_p = evaluate(keys, n, pairs, singles, order) if ending is None else evaluate_part(keys, n, ending, pairs, singles, order)
        return pa.table({"bucket": _bucket(keys, buckets).astype(np.int32), "gram": keys, "log_p": log_p})

    return run


def _wanted(order, buckets):
    """The distinct (context, byte) and words of a chunk, by bucket."""

    def run(table):
        chunk = table.column("chunk")[0].as_py()
        data, offsets = text_bytes(table.column("text"))
        found, held, most, words = [], 0, 4 * MOST, set()
        for _, part, at in slices(data, offsets, SLICE):
            part = LOWER[part]
            found.append(_once(gram_keys(part, at, order)[0]))
            held += len(found[-1])
            if held > most:  # a chunk is as long as its repeated rows make it
                found = [_once(np.concatenate(found))]
                held = len(found[0])
                most = max(most, 2 * held)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                words.update(part[lo:hi].tobytes().split())
        words, keys = list(words), _once(np.concatenate([np.zeros(0, np.int64), *found]))
        rows = _by_bucket(keys, np.zeros(len(keys), np.int64), words, np.zeros(len(words), np.int64), buckets)
        return _table([(chunk, bucket, grams, held) for bucket, grams, _, held, _ in rows], WANTED)

    return run


def _answered(wanted, values):
    """Adds to each chunk's wishes of a bucket the log probabilities and the word counts."""
    grams = values.filter(pc.is_valid(values.column("gram")))
    words = values.filter(pc.is_null(values.column("gram")))
    keys, log_p = grams.column("gram").to_numpy(), grams.column("value").to_numpy()
    order = np.argsort(keys)
    keys, log_p = keys[order], log_p[order]
    count = dict(zip(words.column("word").cast(pa.binary()).to_pylist(), words.column("value").to_pylist()))
    rows = []
    for chunk, held_keys, held_words in zip(*(wanted.column(c).to_pylist() for c in ("chunk", "grams", "words"))):
        mine = np.frombuffer(held_keys, np.int64)
        values_ = log_p[np.searchsorted(keys, mine)] if len(mine) else np.zeros(0)
        counts = np.array([count[w] for w in _split(held_words)], np.float64)
        rows.append((chunk, held_keys, values_.tobytes(), held_words, counts.tobytes()))
    return _table(rows, ANSWERS)


def _scored(order):
    def run(texts, answers):
        data, offsets = text_bytes(texts.column("text"))
        load = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in answers.column(c).to_pylist())])
        keys, log_p = load("grams", np.int64), load("log_p", np.float64)
        place = pd.Index(keys)
        words = [w for held in answers.column("words").to_pylist() for w in _split(held)]
        counts = load("word_counts", np.float64)
        worth, known = dict(zip(words, np.log10(counts + 0.5).tolist())), math.log10(0.75)
        scores, bases, lengths, seen = [], [], [], []
        for _, part, bounds in slices(data, offsets, SLICE):
            part = LOWER[part]
            wanted, first = gram_keys(part, bounds, order)
            scores.append(np.add.reduceat(log_p[place.get_indexer(wanted)], first))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = part[lo:hi].tobytes().split()
                values_ = np.fromiter(map(worth.__getitem__, own), float, len(own))
                bases.append(float(values_.sum()))
                lengths.append(len(own))
                seen.append(int((values_ > known).sum()))
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"),
            "words": pa.array(lengths, pa.int64()), "known": pa.array(seen, pa.int64()), "worth": pa.array(bases, pa.float64()),
            "score": pa.array(np.concatenate(scores) if scores else np.zeros(0)),
        })

    return run


def score(docs, held_out, order=ORDER, chunk_bytes=16 << 20, most_alike=HEAVY):
    """Scores of every document by a model of those for which ``held_out`` (a column) is false.

    ``score`` is log10 of the model's probability of the text and its end, ``base_score`` that of the
    words and the end under smoothed word counts.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-size // chunk_bytes)), 64
    # Groups stay near one chunk up to 16 TB and grow by six times to 100 TB; a chunk sends no more rows than it has keys.
    while buckets < 1 << 20 and buckets * chunk_bytes < size:
        buckets *= 2
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")
    texts = docs.select(chunk, F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    counts = texts.select("text", "held_out").mapInArrow(_counted(order, buckets), COUNTS)
    totals = stage(counts.groupBy("bucket").applyInArrow(_totals(order), "bucket int, gram long, word string, n long"))
    grams, words = totals.filter("gram IS NOT NULL"), totals.filter("gram IS NULL")
    pairs, singles = low_orders(grams, order)
    tokens, types, ends = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))
    ).first()
    # Keys that end in the same two bytes are one group; where these are too many, those that end in three.
    heavy = heavy_endings(grams, order, most_alike) if order > 2 else {}
    alike = F.shiftright("gram", 8 * (order - 1))
    alike = F.when(alike.isin(list(heavy)), F.shiftright("gram", 8 * (order - 2)) + F.lit(1 << 16)).otherwise(alike) if heavy else alike
    valued = grams.select(alike.alias("ending"), "gram", "n").groupBy("ending").applyInArrow(_evaluated(pairs, singles, order, buckets, heavy), "bucket int, gram long, log_p double")
    values = valued.select("bucket", "gram", F.lit(None).cast("string").alias("word"), F.col("log_p").alias("value")).unionByName(
        words.select("bucket", "gram", "word", F.col("n").cast("double").alias("value"))
    )
    wanted = texts.groupBy("chunk").applyInArrow(_wanted(order, buckets), WANTED)
    answers = wanted.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(_answered, ANSWERS)
    scored = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _scored(order), "doc_id long, held_out boolean, words long, known long, worth double, score double"
    )
    whole = math.log10(tokens + 0.5 * (types + 1))
    n_tokens = F.col("words") + 1
    return scored.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("worth") + F.lit(math.log10(ends + 0.5)) - n_tokens * F.lit(whole)).alias("base_score"),
        "score",
    )
