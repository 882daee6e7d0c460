"""Suffix-array dedup with a run-compressed index.

A byte is removed if it lies in a string of WINDOW bytes that also starts in a document with a smaller
id. All such strings are found, and none else:

1. Every WINDOW-byte string has an anchor, its GRAM-byte substring with the smallest hash, the leftmost
   of equal ones, which is at the same place in the string wherever that stands. Blocks of documents send
   the hashes of their anchors to buckets (four bytes each), which tell each block those that occur in
   two documents or more.
2. Around each such anchor a document has a segment, the neighbouring strings with that anchor. A block
   sends each distinct segment once, with the smallest id that has it, to the shard of its anchor.
   Anchors that more than HOT_BLOCKS blocks share are refined: a string reaches 15 bytes beyond the
   anchor to the left, or else to the right, and goes to the shard of the anchor with those bytes.
3. A shard builds the run-compressed Burrows-Wheeler transform of its segments, with samples at run ends
   (RunIndex). Each segment is streamed backwards through it, which gives the matching statistics: how far
   each position matches another one, and for matches of WINDOW bytes or more the smallest id among their
   holders, which is sent back to the blocks.
4. Blocks mark what is covered, judged on the input, and cut it out.

What a shard gets from a group of copies is one segment from each block, whatever the group's size. The
numbers of buckets, shards and partitions follow the input, so that tasks don't grow with it. A block sends
one row to a bundle of up to BUNDLE x MOST_TIMES shards, whose indexes are built one after the other: rows between blocks and
single shards would outgrow the texts, as both numbers follow the input.

Defined results: null and empty texts have no bytes and lose none; rows with the same id don't count
against each other; a null id counts as larger than all. Texts shorter than WINDOW bytes stay. Repeated
rows each give a row; ties (equal texts) are settled by id. A very long text is a block of its own, read
as one slab. Cutting bytes can split characters: remove_repeats() drops what is left of a split character.
Empty tables give an empty result. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slabs import mix, prefix_hash, range_hash, ranges, slabs, trim

WINDOW = 50
GRAM = 20
#: Text bytes of a block of documents, and of the parts in which a block is read.
BLOCK_BYTES, PART_BYTES = 4 << 20, 1 << 17
#: Anchors that a bucket holds on average.
BUCKET_KEYS = 2_000_000
HOT_BLOCKS = 64
#: Shards for each block. Shards of a bundle at first; so many times as many, at most, one time for each BUNDLE_BLOCKS blocks.
SHARDS, BUNDLE, MOST_TIMES, BUNDLE_BLOCKS = 8, 4, 16, 64
_SIDE = (WINDOW - GRAM) // 2
_LAST_ID = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the WINDOW-byte strings within rows: position, row, 64-bit hash, and the first and last
    start of the neighbouring strings that have it. Each string belongs to one anchor."""
    none = np.zeros(0, np.int64)
    span = WINDOW - GRAM + 1
    n = len(data) - WINDOW + 1
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), none, none
    p = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    # the position modulo 64 breaks ties; a string over which it wraps takes the one that is shifted by 32
    h = range_hash(p, at, at + GRAM)
    near = _least(h, at & 63, span)
    wrapped = np.arange(n) & 63 > 64 - span
    near[wrapped] = _least(h, at + 32 & 63, span)[wrapped] ^ np.uint64(32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.flatnonzero(np.arange(n) + WINDOW <= offsets[row + 1])
    if not len(start):
        return none, none, np.zeros(0, np.uint64), none, none
    found = start + (((near[start] & np.uint64(63)).astype(np.int64) - start) & 63)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    found, begin = found[first], start[first]
    end = start[np.append(first[1:], len(start)) - 1]
    return found, np.searchsorted(offsets, found, "right") - 1, h[found], begin, end


def _least(h: np.ndarray, tie: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours, where `tie` stands for the six low bits."""
    low = (h & ~np.uint64(63)) | tie.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: width - span], low[span - width :]) if width < span else low


class Marks:
    """Marked rows as bits, with the number of marks before each word of them."""

    def __init__(self, rows: np.ndarray, n: int):
        marked = np.zeros((n >> 6) + 1 << 6, bool)
        marked[rows] = True
        self.word = np.packbits(marked, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.word), np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(np.bitwise_count(self.word[:-1]), out=self.before[1:])

    @property
    def nbytes(self) -> int:
        return self.word.nbytes + self.before.nbytes

    def last(self, row: np.ndarray) -> np.ndarray:
        """Number of the last mark at or before each row, from 0 (-1: none)."""
        at = row >> 6
        upto = np.uint64((1 << 64) - 1) >> (63 - (row & 63)).astype(np.uint64)
        return self.before[at] + np.bitwise_count(self.word[at] & upto) - 1


class RunIndex:
    """Run-compressed BWT of byte strings with samples at run ends; the suffix array exists only while it is built.

    A row stands for a suffix. Suffixes end with their string; equal ones are ordered by string, as if each
    had an end mark of its own. `ids` are the strings' holders. What is kept for each run of equal preceding
    characters (0: the suffix is a whole string): its first and last row, the first row's LF, and the samples at its ends:
    how much the LF of its first row shares with the row above, and that of its last row with the row below; inside
    a run both lengths grow by one from a row to its LF. Besides, the first row and the smallest holder of each
    set of two rows or more that share `window` bytes, of which there are as many as different strings of
    `window` bytes that occur again, however often they do. First rows are found by their bits (Marks).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, window: int = WINDOW):
        n = len(data)
        small = np.int32 if n < 1 << 31 else np.int64
        self.n, self.window, self.size = n, window, np.diff(offsets)
        full = self.size > 0
        room = (np.repeat(offsets[1:], self.size) - np.arange(n)).astype(small)  # bytes up to the end of the string
        char = np.concatenate([data + np.uint8(1), np.zeros(8, np.uint8)])  # UTF-8 has no byte 255
        word = np.ndarray(n, ">u8", char.data, strides=(1,)).astype(np.uint64)  # eight characters from each position
        key = word >> np.uint64(24)
        short = np.flatnonzero(room < 5)
        beyond = np.uint64(8) * (np.uint64(5) - room[short].astype(np.uint64))
        key[short] = key[short] >> beyond << beyond
        bits = (n + 2).bit_length()
        rank, order = _rank(key, 40, bits)
        step, longest = 5, int(self.size.max(initial=0))
        ranks = [(step, rank)]  # equal ranks share that many bytes, or end together
        while step < longest:
            key = rank.astype(np.uint64) << np.uint64(bits)
            key[:-step] |= np.where(room[:-step] > step, rank[step:] + 1, 0).astype(np.uint64)
            rank, order = _rank(key, 2 * bits, bits)
            step *= 2
            ranks.append((step, rank))
        del key

        def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Bytes that the suffixes at a and b share."""
            most = np.minimum(room[a], room[b])
            out = np.zeros(len(a), small)
            for depth, level in reversed(ranks[1:]):
                same = level[np.minimum(a + out, n - 1)] == level[np.minimum(b + out, n - 1)]
                out = np.minimum(out + depth * same.astype(small), most)
            on = np.flatnonzero(out < most)
            while len(on):  # eight at once; about ten are left at most
                other = word[a[on] + out[on]] ^ word[b[on] + out[on]]
                same = np.zeros(len(on), small)
                for k in range(0, 64, 8):
                    same += other >> np.uint64(k) == 0
                out[on] = np.minimum(out[on] + same, most[on])
                on = on[(same == 8) & (out[on] < most[on])]
            return out

        # classes: neighbours that share `window` bytes, told by the two ranks that cover these
        depth, level = max((x for x in ranks if x[0] <= window), default=(0, None), key=lambda x: x[0])
        above, below = order[:-1], order[1:]
        enough = (room >= window)[order]
        alike = np.flatnonzero(enough[:-1] & enough[1:])
        reach = 0
        while depth and reach < window:
            reach = min(reach, window - depth)
            alike = alike[level[above[alike] + reach] == level[below[alike] + reach]]
            reach += depth
        if not depth:
            alike = alike[shared(above[alike], below[alike]) >= window]
        head = np.ones(n, bool)
        head[alike + 1] = False
        begin = np.flatnonzero(head)
        count = np.diff(np.append(begin, n))
        begin, count = begin[count > 1], count[count > 1]
        holder = ids[np.repeat(np.arange(len(ids), dtype=small), self.size)[order[ranges(begin, count)]]]
        self.least = np.minimum.reduceat(holder, np.cumsum(count) - count) if len(begin) else ids[:0]
        self.matches = Marks(begin, n)

        before = char[order - 1]
        whole = np.zeros(n, bool)
        whole[offsets[:-1][full]] = True
        before[whole[order]] = 0
        fresh = np.ones(n, bool)
        fresh[1:] = before[1:] != before[:-1]
        run = np.flatnonzero(fresh)
        end = np.append(run[1:], n)[: len(run)] - 1
        self.char = before[run]
        self.heads = Marks(run, n)

        # rows that start with c: first the suffixes of one character, by string, then the others by the row they precede
        count = np.bincount(char[:n], minlength=258)
        last = char[offsets[1:][full] - 1].astype(np.int64)
        start, alone = np.cumsum(count) - count, np.bincount(last, minlength=258)
        nth = np.zeros(len(last), np.int64)
        by = np.argsort(last, kind="stable")
        nth[by] = ranges(np.zeros(258, np.int64), alone)
        self.entry = np.zeros((3, len(self.size)), np.int64)  # of each string's last character: row, shared above and below
        self.entry[:, full] = start[last] + nth, nth > 0, nth + 1 < count[last]
        by = np.argsort(self.char, kind="stable")
        length, c = (end - run + 1)[by], self.char[by].astype(np.int64)
        done = np.cumsum(length) - length
        base = np.zeros(258, np.int64)
        heads = np.flatnonzero(np.diff(c, prepend=-1))
        base[c[heads]] = done[heads]
        lf = np.zeros(len(run), np.int64)
        lf[by] = (start + alone)[c] + done - base[c]
        up, down = np.zeros(len(run), small), np.zeros(len(run), small)
        k = np.flatnonzero((self.char > 0) & (lf > 0))
        up[k] = shared(order[lf[k] - 1], order[lf[k]])
        # the LFs of the runs of one character follow each other; below the last of them another character begins
        down[by[:-1]] = np.where(c[1:] == c[:-1], up[by[1:]], 0)
        self.runs = np.stack([x.astype(small) for x in (run, end, lf, up, down)], 1)

    @property
    def run(self) -> np.ndarray:
        return self.runs[:, 0]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, (np.ndarray, Marks)))

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the strings, one after the other: bytes that it shares with another position at most,
        and the smallest holder of the `window` bytes from it, if these are shared (else _LAST_ID)."""
        length, holder = np.zeros(self.n, self.runs.dtype), np.full(self.n, _LAST_ID)
        offsets = np.cumsum(self.size)
        order = np.argsort(-self.size, kind="stable")
        row, up, down = (x[order].astype(self.runs.dtype) for x in self.entry)
        last = offsets[order] - 1
        sizes = -self.size[order]
        for k in range(int(self.size.max(initial=0))):
            live = int(np.searchsorted(sizes, -k, "left"))  # strings longer than k
            row, up, down = row[:live], up[:live], down[:live]
            at = last[:live] - k
            length[at] = most = np.maximum(up, down)
            some = np.flatnonzero(most >= self.window)
            holder[at[some]] = self.least[self.matches.last(row[some])]
            first, end, lf, above, below = self.runs.take(self.heads.last(row), 0).T
            up, down = np.where(row == first, above, up + 1), np.where(row == end, below, down + 1)
            row = lf + (row - first)
        return length, holder


def _rank(key: np.ndarray, key_bits: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key, and the positions by key and place. Where both fit in a word, words are sorted."""
    if key_bits + bits <= 64:
        key = key << np.uint64(bits)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << bits) - 1)).view(np.int64)
        key >>= np.uint64(bits)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    fresh = np.zeros(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    rank = np.empty(len(key), np.int32 if len(key) < 1 << 31 else np.int64)
    rank[order] = np.cumsum(fresh, dtype=rank.dtype)
    return rank, order


def smallest_holders(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each position the smallest id of a string that has the `window` bytes from there (max: too short)."""
    length, holder = RunIndex(data, offsets, ids, window).matching_statistics()
    size = np.diff(offsets)
    room = np.repeat(offsets[1:], size) - np.arange(len(data))
    return np.where(room < window, _LAST_ID, np.where(length >= window, holder, np.repeat(ids, size)))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(table: pa.Table):
    """Slabs of a block's rows, always in the same order."""
    for batch in table.combine_chunks().to_batches():
        yield from slabs(batch, "text", PART_BYTES)


def _canonical(table: pa.Table) -> pa.Table:
    """Rows by id and text, so that a block that is computed again looks the same."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The same type with fields that may be null, as the result's schema has them."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    return kind


def _unpack(cells, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(c.as_py() for c in cells), dtype)


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _swell(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def mark_repeats(docs: DataFrame, cut: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with cut, also the struct `row` and the kept text.

    docs: doc_id, text and, with cut, row, which has the other columns.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4))
    bits = max(6, int(total // 16 // BUCKET_KEYS).bit_length())
    shards = SHARDS * blocks
    bundle = BUNDLE * min(MOST_TIMES, max(1, blocks // BUNDLE_BLOCKS))
    bundles = -(-shards // bundle)
    block = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)), F.lit(0)).cast("int")
    held = docs.select(block.alias("block"), "doc_id", "text", *(["row"] if cut else [])).repartition(partitions, "block")

    # of the mixed hash: an anchor's own is the least of many, and nearly all of these begin with zeros
    def split_key(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - bits)).astype(np.int64), ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def keys_of_block(table: pa.Table) -> pa.Table:
        found = []
        ids = _canonical(table)
        for part, data, offsets in _parts(ids):
            _, row, h, _, _ = anchors(data, offsets)
            found.append(np.stack([mix(h), _ids(part.column(part.schema.get_field_index("doc_id")))[row].view(np.uint64)]))
        pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.uint64)
        pairs = pairs[:, np.lexsort(pairs[::-1])]
        fresh = np.ones(pairs.shape[1], bool)
        fresh[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(0)
        h = pairs[0, fresh]  # once for each document
        third = np.zeros(len(h), bool)
        third[2:] = h[2:] == h[:-2]
        bucket, low = split_key(h[~third])  # two of a kind say that it repeats
        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        some = np.flatnonzero(np.diff(cuts))
        number = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(some, pa.int32()), "block": pa.array([number] * len(some), pa.int32()), "keys": pa.array([np.sort(low[cuts[b] : cuts[b + 1]]).tobytes() for b in some], pa.binary())})

    keys = held.groupBy("block").applyInArrow(keys_of_block, "bucket int, block int, keys binary").repartition(max(partitions, 1 << bits), "bucket")

    def repeated_keys(table: pa.Table) -> pa.Table:
        cells = [np.frombuffer(c.as_py(), np.uint32) for c in table.column("keys")]
        each, listed = np.array([len(c) for c in cells]), np.concatenate(cells)
        whole = np.sort(listed)
        again = np.flatnonzero(whole[1:] == whole[:-1])
        twice, times = np.unique(whole[again], return_counts=True)
        hot = times >= HOT_BLOCKS  # one more than these
        del whole, again
        fresh = np.ones(len(listed), bool)  # cells are sorted
        fresh[1:] = listed[1:] != listed[:-1]
        fresh[np.cumsum(each) - each] = True
        own, cell = listed[fresh], np.repeat(np.arange(len(cells), dtype=np.int32), each)[fresh]
        del listed, fresh
        at = np.minimum(np.searchsorted(twice, own), max(0, len(twice) - 1))
        hit = twice[at] == own if len(twice) else np.zeros(len(own), bool)
        own, is_hot = own[hit], hot[at[hit]].astype(np.uint8)
        cuts = np.searchsorted(cell[hit], np.arange(len(cells) + 1)).tolist()
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"block": table.column("block").cast(pa.int32()), "bucket": pa.array([bucket] * len(cells), pa.int32()), "keys": pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), "hot": pa.array([is_hot[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    repeated = keys.groupBy("bucket").applyInArrow(repeated_keys, "block int, bucket int, keys binary, hot binary")

    asked_schema = "bundle int, block int, base int, n int, payload binary"

    def segments_of_block(table: pa.Table, found: pa.Table) -> pa.Table:
        """A row for each bundle: ids, lengths, shards and bytes of its segments; a last row with the places of all."""
        empty = pa.table({"bundle": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "base": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        if not table.num_rows or not found.num_rows:
            return empty
        number = table.column("block")[0].as_py()
        per = [np.frombuffer(c.as_py(), np.uint32) for c in found.column("keys")]
        known = np.concatenate([(np.uint64(b) << np.uint64(32)) | k.astype(np.uint64) for b, k in zip(found.column("bucket").to_pylist(), per, strict=True)])
        hot = _unpack(found.column("hot"), np.uint8)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        if not len(known):
            return empty
        hashes, shard_of, least, strings, places = [], [], [], [], []
        base = 0
        for part, data, offsets in _parts(_canonical(table)):
            ids = _ids(part.column(part.schema.get_field_index("doc_id")))
            at, row, h, begin, end = anchors(data, offsets)
            bucket, low = split_key(mix(h))
            full = (bucket.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
            where = np.minimum(np.searchsorted(known, full), len(known) - 1)
            hit = known[where] == full
            at, row, h, begin, end, is_hot = at[hit], row[hit], h[hit], begin[hit], end[hit], hot[where[hit]] > 0
            p = prefix_hash(data)
            raw = data.tobytes()
            # strings with a refined anchor reach _SIDE bytes beyond it on the left, or else on the right
            middle = at - _SIDE
            left, right = is_hot & (begin <= middle), is_hot & (end > middle)
            back, ahead = np.maximum(middle, 0), np.minimum(at + GRAM + _SIDE, len(data))
            sets = (
                (~is_hot, h, begin, end),
                (left, range_hash(p, back, at + GRAM), begin, np.minimum(end, middle)),
                (right, range_hash(p, at, ahead), np.maximum(begin, middle + 1), end),
            )
            for which, key, s, e in sets:
                w = np.flatnonzero(which)
                if len(w):
                    k, s, e = key[w], s[w], e[w] + WINDOW
                    seg = mix(range_hash(p, s, e) + mix(k))  # equal bytes in equal shards are one segment
                    unique, first, back_to = np.unique(seg, return_index=True, return_inverse=True)
                    low_id = np.full(len(first), _LAST_ID)
                    np.minimum.at(low_id, back_to, ids[row[w]])
                    hashes.append(unique)
                    shard_of.append((mix(k[first]) % np.uint64(shards)).astype(np.int64))
                    least.append(low_id)
                    strings += [raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
                    # the same segment again and again, as in periodic text, is one place that reaches further
                    of, s = row[w] + base, s - offsets[row[w]]
                    again = (seg[1:] == seg[:-1]) & (of[1:] == of[:-1]) & (s[1:] - s[:-1] <= WINDOW)
                    head = np.flatnonzero(np.concatenate([[True], ~again]))
                    tail = np.append(head[1:], len(s)) - 1
                    places.append(np.stack([seg[head].view(np.int64), of[head], s[head], s[tail] - s[head]]))
            base += part.num_rows
        if not hashes:
            return empty
        unique, first, back_to = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        low_id = np.full(len(unique), _LAST_ID)
        np.minimum.at(low_id, back_to, np.concatenate(least))
        shard = np.concatenate(shard_of)[first]
        order = np.argsort(shard, kind="stable")  # segments are numbered by shard
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        shard, first, low_id = shard[order], first[order], low_id[order]
        size = np.array([len(strings[i]) for i in first], np.uint8)
        to, within = shard // bundle, (shard % bundle).astype(np.uint8)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to))
        rows = {"bundle": [], "block": [], "base": [], "n": [], "payload": []}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            text = np.frombuffer(b"".join(strings[i] for i in first[a:b]), np.uint8)
            for name, x in zip(rows, (int(to[a]), number, a, b - a, _squeeze(low_id[a:b], size[a:b], within[a:b], text)), strict=True):
                rows[name].append(x)
        where = np.concatenate(places, 1)
        which = place[np.searchsorted(unique, where[0].view(np.uint64))]
        packed = _squeeze(which.astype(np.int32), *where[1:].astype(np.int32))
        for name, x in zip(rows, (-1 - number, number, -1, 0, packed), strict=True):
            rows[name].append(x)
        return pa.table(rows, empty.schema)

    asked = held.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(segments_of_block, asked_schema).repartition(max(partitions, bundles), "bundle")

    answer_schema = pa.schema([("block", pa.int32()), ("base", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])

    def answers_of_bundle(table: pa.Table) -> pa.Table:
        """For each block: runs in each of its segments, and first position and smallest holder of each run."""
        if table.column("bundle")[0].as_py() < 0:  # places pass through
            return table.select(answer_schema.names).cast(answer_schema)
        trim()  # of the bundle before
        block, base, n = (table.column(c).to_numpy() for c in ("block", "base", "n"))
        least, size, within, texts = [], [], [], []
        for count, packed in zip(n.tolist(), table.column("payload"), strict=True):
            raw = _swell(packed.as_py())
            least.append(np.frombuffer(raw, np.int64, count))
            size.append(np.frombuffer(raw, np.uint8, count, 8 * count))
            within.append(np.frombuffer(raw, np.uint8, count, 9 * count))
            texts.append(raw[10 * count :])
        least, size, within, text = np.concatenate(least), np.concatenate(size), np.concatenate(within), b"".join(texts)
        del texts
        end = np.cumsum(size, dtype=np.int64)
        code = np.empty(len(size), np.int64)
        n_runs, begins, holders, known = [], [], [], 0
        for which in np.split(np.argsort(within, kind="stable"), np.cumsum(np.bincount(within, minlength=bundle))[:-1]):
            number: dict[bytes, int] = {}
            for_each = zip((end - size)[which].tolist(), end[which].tolist(), strict=True)
            own = np.fromiter((number.setdefault(text[a:b], len(number)) for a, b in for_each), np.int64, len(which))
            ids = np.full(len(number), _LAST_ID)
            np.minimum.at(ids, own, least[which])
            length = np.array([len(x) for x in number], np.int64)
            offsets = np.concatenate([[0], np.cumsum(length)])
            data = np.frombuffer(b"".join(number), np.uint8)
            code[which] = own + known
            known += len(number)
            del number
            holder = smallest_holders(data, offsets, ids)
            of = np.repeat(np.arange(len(length)), length)
            fresh = np.ones(len(holder), bool)
            fresh[1:] = (holder[1:] != holder[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(fresh)
            n_runs.append(np.bincount(of[at], minlength=len(length)).astype(np.uint8))
            begins.append((at - offsets[of[at]]).astype(np.uint8))
            holders.append(holder[at])
        n_runs, begins, holders = np.concatenate(n_runs), np.concatenate(begins), np.concatenate(holders)
        first_run = np.cumsum(n_runs, dtype=np.int64) - n_runs
        payloads, done = [], 0
        for count in n.tolist():
            c = code[done : done + count]
            done += count
            take = ranges(first_run[c], n_runs[c])
            payloads.append(_squeeze(n_runs[c], begins[take], holders[take]))
        return pa.table({"block": block, "base": base, "n": n, "payload": pa.array(payloads, pa.binary())}).cast(answer_schema)

    answers = asked.groupBy("bundle").applyInArrow(answers_of_bundle, "block int, base int, n int, payload binary")

    def cut_block(table: pa.Table, answered: pa.Table) -> pa.Table:
        trim()
        table = _canonical(table)
        raw = [(t.as_py() or "").encode() for t in table.column("text")]
        size = np.array([len(x) for x in raw], np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        ids = _ids(table.column("doc_id").combine_chunks())
        gone = np.zeros(int(offsets[-1]) + 1, np.int32)
        heads = np.zeros(len(gone), bool)
        heads[offsets] = True
        answered = answered.sort_by("base") if answered.num_rows else answered
        if answered.num_rows:  # the first row has the places
            payloads = [_swell(x) for x in answered.column("payload").to_pylist()]
            which, row, start, further = np.frombuffer(payloads[0], np.int32).reshape(4, -1).astype(np.int64)
            counts, firsts, holders = [], [], []
            for n, said in zip(answered.column("n").to_pylist()[1:], payloads[1:], strict=True):
                counts.append(np.frombuffer(said, np.uint8, n))
                runs = (len(said) - n) // 9
                firsts.append(np.frombuffer(said, np.uint8, runs, n))
                holders.append(np.frombuffer(said[n + runs :], np.int64))
            count = np.concatenate(counts).astype(np.int64)
            first, holder = np.concatenate(firsts).astype(np.int64), np.concatenate(holders)
            begin = np.cumsum(count) - count
            k = which
            run = ranges(begin[k], count[k])
            occ = np.repeat(np.arange(len(k)), count[k])
            from_ = first[run]
            after = np.append(first[1:], 0)  # where a run ends: the next run's start
            hit = (holder[run] < ids[row[occ]]) & (holder[run] != _LAST_ID)
            occ, from_, until = occ[hit], from_[hit], after[run[hit]]
            # strings start at from_ .. until - 1; the last run of a segment is too short for one
            left = offsets[row[occ]] + start[occ] + from_
            right = offsets[row[occ]] + start[occ] + further[occ] + until - 1 + WINDOW
            np.add.at(gone, left, 1)
            np.add.at(gone, np.minimum(right, offsets[row[occ] + 1]), -1)
        np.cumsum(gone, out=gone)
        removed = gone > 0
        del gone
        # spans: from where removed bytes begin, or a text does, to where they end
        edge = np.flatnonzero(heads[1:] | (removed[1:] != removed[:-1])) + 1
        edge = np.concatenate([[0], edge])
        begin, end = edge[:-1][removed[edge[:-1]]], edge[1:][removed[edge[:-1]]]
        of = np.searchsorted(offsets, begin, "right") - 1
        n_removed, n_spans = np.zeros(len(size), np.int64), np.bincount(of, minlength=len(size))
        np.add.at(n_removed, of, end - begin)
        first = np.searchsorted(of, np.arange(len(size) + 1)).tolist()
        spans = list(zip((begin - offsets[of]).tolist(), (end - offsets[of]).tolist(), strict=True))
        kept = []
        for text, a, b in zip(raw, first, first[1:], strict=False):
            begins, ends = [0, *(e for _, e in spans[a:b])], [*(s for s, _ in spans[a:b]), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(begins, ends, strict=True)) if b > a else text)
        out = {"doc_id": table.column("doc_id"), "n_bytes": pa.array(size), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        if cut:
            out["row"] = table.column("row").cast(_nullable(table.column("row").type))
            out["kept"] = pa.array([x.decode("utf-8", "ignore") if there else None for there, x in zip(table.column("text").is_valid().to_pylist(), kept, strict=True)], pa.string())
        return pa.table(out)

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if cut:
        schema += f", row {docs.schema['row'].dataType.simpleString()}, kept string"
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut_block, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns, without repeated strings in `text`."""
    others = [c for c in docs.columns if c != "text"]
    marked = mark_repeats(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")), cut=True)
    return marked.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_run_index(spark, sf_dir: str) -> DataFrame:
    return mark_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
