"""Exact removal of repeated byte strings with suffix order and a bounded search on the BWT.

Every string of ``length`` bytes has one anchor: the smallest hash among its ``GRAM``-byte parts. A
maximal run of neighbouring strings with one anchor is a segment, and equal strings have equal
anchors wherever they stand. So anchors are first counted over all documents; only segments whose
anchor occurs in more than one document are brought together, by anchor. There the suffixes of all
distinct segments are ordered, and breadth-first backward extension on the Burrows-Wheeler transform
sets common prefix lengths by increasing value until ``length``; what is still unset then is an
interval of equal strings, and its smallest document id decides. Anchors found in more than
``HOT`` documents are not gathered: their strings are dealt out one by one, by their own hash.

Documents are dealt into blocks of about ``block_bytes``; a segment that a block repeats is sent
once, with the smallest id that has it there.

Cases: a null text is empty; texts under ``length`` bytes lose nothing; rows with equal ids are one
document; a null id counts as larger than every other; what is cut inside a character leaves bytes
that are dropped when kept text is asked for.
Columns in ``carry`` go along under their own names; others are not looked at. A text is worked on whole: one
longer than a block is a block of its own, with about twenty-five bytes of memory for each of its bytes.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxstars.llm.texts import PRIME, mixed, text_bytes, token_hashes

LENGTH = 50
GRAM = 20
HOT = 4096
STEP = 1 << 20
LAST = np.iinfo(np.int64).max
ANCHORS = "bucket int, block int, once binary, twice binary, counts binary"
REPEATED = "block int, bucket int, some binary, hot binary, ids binary, masks binary"
SEGMENTS = "part int, block int, keys binary, sizes binary, docs binary, content binary"


def _gram_hashes(data, size):
    """A hash of every ``size`` neighbouring bytes, from hashes of 1, 2, 4, ... bytes."""
    part, length, power = data.astype(np.uint64) + np.uint64(1), 1, PRIME
    whole, done, shift = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if size & length:
                if whole is None:
                    whole = part
                else:
                    n = len(data) - done - length + 1
                    whole = whole[:n] + shift * part[done : done + n]
                done += length
                shift = shift * power
            if length * 2 > size:
                break
            part = part[:-length] + power * part[length:]
            length, power = length * 2, power * power
        return mixed(whole)


def _least(values, width):
    """The smallest of every ``width`` neighbouring values."""
    have = 1
    while have * 2 <= width:
        values, have = np.minimum(values[:-have], values[have:]), have * 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(data, offsets, length=LENGTH, gram=GRAM):
    """Segments: first string's place, number of strings, anchor and content hash."""
    n = len(data)
    starts, ends = offsets[:-1], offsets[1:]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(starts, ends - length + 1), 1)
    np.add.at(edge, ends, -1)
    whole = np.cumsum(edge[:n], dtype=np.int32) == 0  # strings that end within their text
    out = []
    for a in range(0, n, STEP):
        part = data[a : a + STEP + length - 1]
        if len(part) < length:
            break
        least = _least(_gram_hashes(part, gram), length - gram + 1)
        valid = whole[a : a + len(least)]
        cut = np.ones(len(least), bool)
        cut[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(cut)
        count = np.diff(np.r_[first, len(least)])
        keep = valid[first]
        first, count = first[keep], count[keep]
        out.append((first + a, count, mixed(least[first]), token_hashes(part, first, first + count + length - 1)))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _code(anchors, buckets):
    """Bucket and rest of an anchor in one number."""
    return ((anchors & np.uint64(buckets - 1)) << np.uint64(32)) | (anchors >> np.uint64(32))


def _block(table):
    """A block's rows in an order of their own: shuffles deliver them in any, and runs are cut by place."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, offsets = text_bytes(table.column("text"))
    return table, data, offsets, pc.fill_null(table.column("doc_id"), LAST).to_numpy()


def _anchors(buckets):
    def run(table):
        block = table.column("block")[0].as_py()
        _, data, offsets, _ = _block(table)
        first, _, anchors, _ = runs(data, offsets)
        codes, rows = _code(anchors, buckets), np.searchsorted(offsets, first, "right")
        order = np.argsort(codes, kind="stable")
        codes, rows = codes[order], rows[order]
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        other = new.copy()
        other[1:] |= rows[1:] != rows[:-1]
        at = np.flatnonzero(new)
        texts = np.add.reduceat(other.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        codes = codes[at]
        cells = (codes >> np.uint64(32)).astype(np.int64)
        rest = codes.astype(np.uint32)
        bounds = np.searchsorted(cells, np.arange(buckets + 1))
        out = []
        for bucket in np.flatnonzero(np.diff(bounds)).tolist():
            lo, hi = bounds[bucket], bounds[bucket + 1]
            many = texts[lo:hi] > 1
            out.append((
                bucket, block, rest[lo:hi][~many].tobytes(), rest[lo:hi][many].tobytes(),
                np.minimum(texts[lo:hi][many], 1 << 31).astype(np.uint32).tobytes(),
            ))
        return _table(out, ANCHORS)

    return run


def _table(rows, schema):
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _repeated(hot):
    """Of one bucket: for each block, its anchors that are in several documents, and those in very many."""

    def run(table):
        bucket = table.column("bucket")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "once", "twice", "counts"))))
        rest, block, count = [], [], []
        for b, once, twice, counts in rows:
            one, two = np.frombuffer(once, np.uint32), np.frombuffer(twice, np.uint32)
            rest += [one, two]
            count += [np.ones(len(one), np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)]
            block.append(np.full(len(one) + len(two), b, np.int32))
        rest, block, count = np.concatenate(rest), np.concatenate(block), np.concatenate(count)
        values, at = np.unique(rest, return_inverse=True)
        texts = np.bincount(at, weights=count)[at]
        found = texts > 1
        rest, block, many = rest[found], block[found], texts[found] > hot
        order = np.lexsort((rest, block))
        rest, block, many = rest[order], block[order], many[order]
        out = []
        for b in np.unique(block).tolist():
            lo, hi = np.searchsorted(block, [b, b + 1])
            out.append((b, bucket, rest[lo:hi][~many[lo:hi]].tobytes(), rest[lo:hi][many[lo:hi]].tobytes(), None, None))
        return _table(out, REPEATED)

    return run


def _codes_of(table, column):
    """Sorted codes of the anchors that the rows of a block name."""
    parts = [
        (np.uint64(bucket) << np.uint64(32)) | np.frombuffer(rest, np.uint32).astype(np.uint64)
        for bucket, rest in zip(table.column("bucket").to_pylist(), table.column(column).to_pylist())
        if rest
    ]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _within(values, sorted_values):
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def shared_segments(data, offsets, known, buckets, length=LENGTH):
    """Segments with anchors that several documents have: place, strings, key, id and row of each.

    Very common anchors' segments are cut into single strings, each with its own hash as key and id.
    """
    first, count, anchors, ids = runs(data, offsets)
    codes = _code(anchors, buckets)
    some, hot = _within(codes, _codes_of(known, "some")), _within(codes, _codes_of(known, "hot"))
    at = np.repeat(first[hot] - np.r_[0, np.cumsum(count[hot])[:-1]], count[hot]) + np.arange(count[hot].sum())
    own = np.zeros(len(at), np.uint64)
    for a in range(0, len(data), STEP):
        lo, hi = np.searchsorted(at, [a, a + STEP])
        if hi > lo:
            own[lo:hi] = token_hashes(data[a : a + STEP + length - 1], at[lo:hi] - a, at[lo:hi] - a + length)
    place = np.r_[first[some], at]
    return (
        place, np.r_[count[some], np.ones(len(at), np.int64)], np.r_[codes[some], own], np.r_[ids[some], own],
        np.searchsorted(offsets, place, "right") - 1,
    )


def _gather(data, place, size):
    """The bytes of many pieces, one after the other."""
    start = np.r_[0, np.cumsum(size)[:-1]]
    return data[np.repeat(place - start, size) + np.arange(size.sum())]


def _once(ids, docs):
    """First index of each distinct id and the smallest document with it."""
    order = np.lexsort((docs, ids))
    new = np.ones(len(ids), bool)
    new[1:] = ids[order][1:] != ids[order][:-1]
    return order[new]


def _segments(buckets, length):
    def run(texts, known):
        if not len(known) or not len(texts):
            return _table([], SEGMENTS)
        block = texts.column("block")[0].as_py()
        _, data, offsets, doc_ids = _block(texts)
        place, count, keys, ids, rows = shared_segments(data, offsets, known, buckets, length)
        at = _once(ids, doc_ids[rows])
        part = (mixed(keys[at]) & np.uint64(buckets - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at, part = at[order], part[order]
        bounds = np.searchsorted(part, np.arange(buckets + 1))
        out = []
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            mine = at[bounds[p] : bounds[p + 1]]
            size = count[mine] + length - 1
            out.append((
                p, block, keys[mine].tobytes(), size.astype(np.uint32).tobytes(),
                doc_ids[rows[mine]].tobytes(), _gather(data, place[mine], size).tobytes(),
            ))
        return _table(out, SEGMENTS)

    return run


def suffix_order(symbols, left, depth):
    """Suffixes in the order of their first ``depth`` symbols, a separator (0) ending each.

    Seven symbols are one key; then ranks of neighbouring parts are joined, doubling the length.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(7):
        step = np.zeros(n, np.int64)
        step[: n - k] = symbols[k:]
        key |= np.where(left > k, step, 0) << (9 * (6 - k))
    have = 7
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        after = np.zeros(n, np.int64)
        after[: n - have] = rank[have:]
        key = (rank << 32) | np.where(left >= have, after + 1, 0)
        have *= 2


def unequal_neighbours(transform, first_symbols, limit):
    """Marks places in suffix order whose common prefix with the place before is under ``limit``.

    Intervals of suffixes that begin alike are extended to the left by every symbol before them. The
    place after an extended interval gets its common prefix length when it is reached first, so
    lengths appear in increasing order; intervals whose end is known already are not followed.
    """
    n = len(transform)
    to = np.empty(n, np.int64)
    to[np.argsort(transform, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    owner = np.zeros(n, np.int32)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for level in range(limit):
        width = high - low
        if not width.sum():
            break
        at = np.repeat(low - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
        of = np.repeat(np.arange(len(low), dtype=np.int32), width)
        if level:  # a separator is only ever the end of what is extended
            inside = transform[at] != 0
            at, of = at[inside], of[inside]
        reached = to[at]
        owner[reached] = of
        reached.sort()
        cut = np.ones(len(reached), bool)
        whose, symbol = owner[reached], first_symbols[reached]
        cut[1:] = (reached[1:] != reached[:-1] + 1) | (whose[1:] != whose[:-1]) | (symbol[1:] != symbol[:-1])
        begin = np.flatnonzero(cut)
        low, high = reached[begin], reached[np.r_[begin[1:], len(reached)] - 1] + 1 if len(begin) else reached
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
    return known[:n]


def smallest_owner(content, size, docs, length=LENGTH):
    """For every byte of the segments: the smallest document with the string that starts there."""
    total = int(size.sum()) + len(size)
    end = np.cumsum(size + 1) - 1  # places of the separators
    symbols = np.zeros(total, np.int16)
    inside = np.ones(total, bool)
    inside[end] = False
    symbols[inside] = content.astype(np.int16) + 1
    left = np.repeat(end, size + 1) - np.arange(total)
    order = suffix_order(symbols, left, length)
    transform = symbols[order - 1]
    first = symbols[order]
    new = unequal_neighbours(transform, first, length)
    owner = np.repeat(docs, size + 1)[order]
    begin = np.flatnonzero(new)
    least = np.empty(total, np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner, begin), np.diff(np.r_[begin, total]))
    return least[inside]


def _masks(length, batch_bytes):
    """Of one part: for each block, the strings of its segments that an earlier document has."""

    def run(table):
        load = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        keys, sizes, docs = load("keys", np.uint64), load("sizes", np.uint32), load("docs", np.int64)
        blocks = np.repeat(np.array(table.column("block").to_pylist(), np.int32), [len(k) for k in keys])
        keys, docs, sizes = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes).astype(np.int64)
        content = np.concatenate(load("content", np.uint8))
        at_byte = np.r_[0, np.cumsum(sizes)[:-1]]
        ids = token_hashes(content, at_byte, at_byte + sizes)
        # Distinct segments in the order of their keys; those alone with their key have nothing to meet.
        order = np.lexsort((docs, ids, keys))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        distinct = np.cumsum(new) - 1
        chosen = order[new]
        first_doc = docs[chosen]
        _, group, members = np.unique(keys[chosen], return_inverse=True, return_counts=True)
        met = np.flatnonzero(members[group] > 1)
        found = {}
        cut = np.flatnonzero(np.r_[True, keys[chosen[met]][1:] != keys[chosen[met]][:-1]]) if len(met) else np.zeros(0, np.int64)
        volume = np.add.reduceat(sizes[chosen[met]], cut) if len(met) else cut
        a = 0
        while a < len(cut):
            b = max(a + 1, int(np.searchsorted(np.cumsum(volume[a:]), batch_bytes, "right")) + a)
            mine = met[cut[a] : cut[b] if b < len(cut) else len(met)]
            a, at = b, chosen[mine]
            least = smallest_owner(_gather(content, at_byte[at], sizes[at]), sizes[at], first_doc[mine], length)
            start = np.r_[0, np.cumsum(sizes[at])[:-1]]
            earlier = least < np.repeat(first_doc[mine], sizes[at])
            strings = sizes[at] - length + 1
            usable = np.arange(len(least)) - np.repeat(start, sizes[at]) < np.repeat(strings, sizes[at])
            earlier &= usable
            for i in np.flatnonzero(np.add.reduceat(earlier, start)).tolist():
                found[int(mine[i])] = np.packbits(earlier[start[i] : start[i] + strings[i]]).tobytes()
        later = np.empty(len(ids), bool)
        which = np.empty(len(ids), np.int64)
        later[order], which[order] = docs[order] > first_doc[distinct], distinct
        masked = np.zeros(len(chosen), bool)
        masked[list(found)] = True
        send = np.flatnonzero(later | masked[which])
        send = send[np.argsort(blocks[send], kind="stable")]
        out = []
        for b in np.unique(blocks[send]).tolist():
            lo, hi = np.searchsorted(blocks[send], [b, b + 1])
            mine = send[lo:hi]
            bits = [
                b"\xff" * ((n + 7) // 8) if late else found[w]
                for n, late, w in zip((sizes[mine] - length + 1).tolist(), later[mine].tolist(), which[mine].tolist())
            ]
            out.append((b, None, None, None, ids[mine].tobytes(), b"".join(bits)))
        return _table(out, REPEATED)

    return run


def covered(data, offsets, doc_ids, known, buckets, length=LENGTH):
    """Marks the bytes to remove of a block's texts."""
    n = len(data)
    place, count, _, ids, rows = shared_segments(data, offsets, known, buckets, length)
    docs = doc_ids[rows]
    at = _once(ids, docs)
    which = np.searchsorted(ids[at], ids)
    whole = docs > docs[at][which]
    gone = np.zeros(n + 1, np.int32)
    np.add.at(gone, place[whole], 1)
    np.add.at(gone, (place + count)[whole], -1)
    gone = np.cumsum(gone[:n], dtype=np.int32) > 0
    # Masks of the segments' first documents; a distinct segment's bits start at a whole byte.
    sent = [(i, m) for i, m in zip(known.column("ids").to_pylist(), known.column("masks").to_pylist()) if i]
    if sent:
        got = np.concatenate([np.frombuffer(i, np.uint64) for i, _ in sent])
        bits = np.unpackbits(np.frombuffer(b"".join(m for _, m in sent), np.uint8)).astype(bool)
        strings = count[at][np.searchsorted(ids[at], got)]
        start = np.r_[0, np.cumsum((strings + 7) // 8 * 8)[:-1]]
        order = np.argsort(got)
        got, start = got[order], start[order]
        first = np.flatnonzero(~whole & _within(ids, got))
        where = np.repeat(place[first] - np.r_[0, np.cumsum(count[first])[:-1]], count[first]) + np.arange(count[first].sum())
        bit = np.repeat(start[np.searchsorted(got, ids[first])] - np.r_[0, np.cumsum(count[first])[:-1]], count[first])
        gone[where] |= bits[bit + np.arange(len(bit))]
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(gone)
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge[:n], dtype=np.int32) > 0


def _removed(buckets, length, names, text_too):
    def run(texts, known):
        texts, data, offsets, doc_ids = _block(texts)
        cut = covered(data, offsets, doc_ids, known, buckets, length) if len(known) else np.zeros(len(data), bool)
        rows, kept_texts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            mine = cut[a:b]
            kept = data[a:b][~mine].tobytes()
            spans = int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(b > a and mine[0])
            rows.append((b - a, int(mine.sum()), spans, hashlib.sha256(kept).hexdigest()))
            if text_too:
                kept_texts.append(kept.decode("utf-8", "ignore"))
        found = pa.table(dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), map(pa.array, zip(*rows)))))
        for name in names:
            column = pa.array(kept_texts) if name == "text" and text_too else texts.column(name)
            found = found.append_column(name, column)
        return found

    return run


def remove_repeats(docs, length=LENGTH, block_bytes=4 << 20, batch_bytes=1 << 20, hot=HOT, carry=("doc_id",)):
    """Byte counts, spans and digest of what is kept of every row, with the columns in ``carry``.

    With ``text`` among them, it is the kept text.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = 64
    # Groups stay near 16 MB of text up to 16 TB and reach 100 MB at 100 TB; a block sends no more rows than it has anchors.
    while buckets < 1 << 20 and buckets * (16 << 20) < size:
        buckets *= 2
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    names = ["doc_id", *[c for c in carry if c != "doc_id"]]
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")]
    others = [c for c in names if c not in ("doc_id", "text")]
    texts = docs.select(block, *kept, *others)
    anchors = texts.groupBy("block").applyInArrow(_anchors(buckets), ANCHORS)
    known = anchors.groupBy("bucket").applyInArrow(_repeated(hot), REPEATED)
    segments = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_segments(buckets, length), SEGMENTS)
    masks = segments.groupBy("part").applyInArrow(_masks(length, batch_bytes), REPEATED)
    answers = known.unionByName(masks).groupBy("block")
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")])
    out.add("kept_sha256", T.StringType())
    for c in names:  # with the nullability of a struct's own fields, which a type's text leaves out
        out.add(c, texts.schema[c].dataType)
    return texts.groupBy("block").cogroup(answers).applyInArrow(_removed(buckets, length, names, "text" in names), out)
