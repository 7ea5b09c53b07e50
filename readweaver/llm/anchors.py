"""Routing of repeated word windows: what both substring operators share.

A window of `length` consecutive words is represented by its minimiser, the
smallest hashed m-gram in it (leftmost of equals), so equal windows have equal
minimisers at equal places.  Three steps lead from documents to groups of
windows that can be equal:

1. count the minimiser hashes of the corpus (map-side sums, one shuffle of
   numbers);
2. put those that occur twice or more into a bit filter of bounded size; more
   repeats than it is made for let through more windows, never fewer;
3. cut the documents' windows that pass into segments, the runs of windows with
   the same minimiser position, and route each by its minimiser's hash.

Minimisers that occur `HOT` times or more are split: their windows are counted one
by one, those that occur once go no further (a second bit filter, over hashes of
whole windows), and the rest are cut into segments anew by the minimisers of much
longer grams, which follow the window's own words and not the frequent gram.  So
the edges of a passage that many documents share are cut alike in all of them.
Equal segments of that kind are combined before they are shuffled: of each, a task
sends the earliest with its words and the others as copies without, dealt evenly,
and no key gathers the rows of a frequent passage.  Copies that go on alike are one,
and so is a line that a document repeats over and over.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .textkit import gram_hashes, join, row_of, slices, splitmix, word_hashes, words

#: Occurrences from which a minimiser's windows are split.  It bounds a shard's memory: 4,000 segments of at most 34 words (windows of 20 words,
#: grams of 6) are 136,000 words.
HOT = 4000
#: Bytes of a word's symbol in a segment.
SYMBOL = 6
#: Words of split segments that a task holds to combine equal ones.
HELD = 1 << 21
#: Mark in a segment's `a` that it stands for copies; places of minimisers are smaller.
STANDS = 1 << 16
#: Bounds of the bit filter, as powers of two: 8 KB and 64 MB.
LEAST_BITS, MOST_BITS = 16, 29
NULL_ID = (1 << 63) - 1


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(did, th, text): the id with null as the largest number, and a hash of the text, which tells rows with the same id apart."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(body).alias("th"), body.alias("text"))


def minimisers(hashes: np.ndarray, first: np.ndarray, length: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, position of each one's minimiser, hash of the m-gram at each position) over the words of a slice."""
    gram, _ = gram_hashes(hashes, first, m)
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), gram
    low = gram >> np.uint64(24) << np.uint64(24) | np.arange(len(gram), dtype=np.uint64) & np.uint64(0xFFFFFF)
    span, w = 1, length - m + 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    at = np.arange(n)
    # the position's lower 24 bits; a window is shorter than that
    place = at + ((low[:n] - at.astype(np.uint64)) & np.uint64(0xFFFFFF)).astype(np.int64)
    row = row_of(first)
    inside = row[at] == row[at + length - 1]
    return at[inside], place[inside], gram


def count_minimisers(docs: DataFrame, length: int, m: int) -> DataFrame:
    """(g, n) of the minimisers that occur twice or more, each position once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                starts, ends, first = words(data, offs)
                _, place, gram = minimisers(word_hashes(data, starts, ends), first, length, m)
                g, n = np.unique(gram[np.unique(place)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])

    return docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")


def bit_filter(counted: DataFrame, least: int, bits: int) -> np.ndarray:
    """2**bits bits, set at the hashes counted `least` times or more; made on the executors in chunks of 8 KB."""
    from .common import fetched

    part = 1 << LEAST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, at = batch.column(0).to_numpy(), batch.column(1)
            for i in range(len(k)):
                chunk = np.zeros(part, np.uint8)
                chunk[at[i].values.to_numpy()] = 1
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 1]), pa.array([np.packbits(chunk, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    place = F.col("g").bitwiseAND((1 << bits) - 1)
    chunks = counted.where(F.col("n") >= least).select(F.shiftright(place, LEAST_BITS).alias("chunk"), place.bitwiseAND(part - 1).cast("int").alias("at"))
    out = np.zeros(1 << bits - 3, np.uint8)
    # at most 65,536 distinct places a chunk, and 2**bits / 65,536 chunks, whatever the corpus
    for r in fetched(chunks.groupBy("chunk").agg(F.collect_set("at").alias("at")).select("chunk", "at").mapInArrow(run, "chunk long, bits binary")):
        out[r.chunk << LEAST_BITS - 3 : (r.chunk + 1) << LEAST_BITS - 3] = np.frombuffer(r.bits, np.uint8)
    return out


def has(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    at = g & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Routes:
    """The filters of a corpus, broadcast."""

    def __init__(self, docs: DataFrame, length: int, m: int, hot: int = HOT) -> None:
        from .common import durable

        self.length, self.m, self.wide = length, m, max(m, length * 13 // 20)
        counted = durable(count_minimisers(docs, length, m))
        bits = min(MOST_BITS, max(LEAST_BITS, (16 * counted.count()).bit_length()))
        sc = docs.sparkSession.sparkContext
        self.seen: Broadcast = sc.broadcast(bit_filter(counted, 2, bits))
        self.hot: Broadcast = sc.broadcast(bit_filter(counted, hot, min(bits, 24)))
        self.again: Broadcast | None = None
        if self.hot.value.any():
            counted = durable(count_windows(docs, self))
            bits = min(MOST_BITS, max(LEAST_BITS, (16 * counted.count()).bit_length()))
            self.again = sc.broadcast(bit_filter(counted, 2, bits))


def count_windows(docs: DataFrame, routes: Routes) -> DataFrame:
    """(g, n) of the whole windows with a frequent minimiser that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                starts, ends, first = words(data, offs)
                hashes = word_hashes(data, starts, ends)
                at, place, gram = minimisers(hashes, first, routes.length, routes.m)
                at = at[has(routes.hot.value, gram[place])]
                g, n = np.unique(gram_hashes(hashes, first, routes.length)[0][at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])

    return docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")


#: A run of windows with one minimiser: its words' symbols and the minimiser's place in it.  A copy has minus its number of windows for the place and,
#: for the words, did, th, start and number of the equal windows that stand for it, once or time after time.
SEGMENT = "g long, did long, th long, start int, a int, words binary"
FIELDS = [f.split()[0] for f in SEGMENT.split(", ")]
_COPY = np.dtype([("did", "<i8"), ("th", "<i8"), ("start", "<i4"), ("n", "<i4")])


def _symbols(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << 8 * SYMBOL) - 1)


def _pack(column: list[np.ndarray], symbols: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """Rows SEGMENT with the symbols from s to e."""
    raw = np.ascontiguousarray(symbols.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SYMBOL]).reshape(-1)
    size = (e - s) * SYMBOL
    before = np.concatenate([[0], np.cumsum(size)])
    body = raw[np.repeat(s * SYMBOL - before[:-1], size) + np.arange(before[-1])]
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(before.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
    return pa.RecordBatch.from_arrays([*map(pa.array, column), packed], FIELDS)


def content(symbols: np.ndarray, offs: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each segment's symbols (offs from 0, no segment empty) and of the numbers in keys."""
    place = np.arange(len(symbols)) - np.repeat(offs[:-1], np.diff(offs))
    out = []
    for seed in (1, 2):
        h = np.add.reduceat(join(symbols + np.uint64(seed << 56), place.astype(np.uint64)), offs[:-1])
        for k in (np.diff(offs), *keys):
            h = join(h, k.astype(np.int64).view(np.uint64))
        out.append(h)
    return out[0], out[1]


def stand_ins(one: np.ndarray, two: np.ndarray, did: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each segment the earliest (by did, then start) of those with both its hashes; segments as early as that stand for themselves."""
    order = np.lexsort((start, did, two, one))
    lead = np.ones(len(order), bool)
    lead[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
    own = (did[head] == did) & (start[head] == start)
    head[own] = np.flatnonzero(own)
    return head


def segments(docs: DataFrame, routes: Routes) -> DataFrame:
    """The documents' windows whose minimiser repeats, as rows SEGMENT."""
    length, wide = routes.length, routes.wide

    def combined(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Split segments (g, did, th, start, a, symbols, sizes): equal ones as one and its copies."""
        g, did, th, start, a, symbols, sizes = (np.concatenate(c) for c in zip(*held))
        offs = np.concatenate([[0], np.cumsum(sizes)])
        head = stand_ins(*content(symbols, offs, g, a), did, start)
        own = head == np.arange(len(head))
        place = a.copy()
        place[head[~own]] |= STANDS
        yield _pack([c[own] for c in (g, did, th, start, place)], symbols, offs[:-1][own], offs[1:][own])
        if not own.all():
            # a document's copies that go on as their stand-ins do are one
            rest = np.flatnonzero(~own)
            rest = rest[np.lexsort((start[rest], th[rest], did[rest]))]
            n = sizes[rest] - length + 1
            goes_on = np.zeros(len(rest), bool)
            goes_on[1:] = True
            for at in (rest, head[rest]):
                goes_on[1:] &= (did[at][1:] == did[at][:-1]) & (th[at][1:] == th[at][:-1]) & (start[at][1:] == start[at][:-1] + n[:-1])
            leads = np.flatnonzero(~goes_on)
            n, rest = np.add.reduceat(n, leads), rest[leads]
            # and so are those that stand for the same windows time after time, as in a line that is repeated
            again = np.zeros(len(rest), bool)
            again[1:] = (n[1:] == n[:-1]) & (start[rest][1:] == start[rest][:-1] + n[:-1])
            for c in (did[rest], th[rest], head[rest]):
                again[1:] &= c[1:] == c[:-1]
            leads = np.flatnonzero(~again)
            each, n, rest = n[leads], np.add.reduceat(n, leads), rest[leads]
            of = np.empty(len(rest), _COPY)
            of["n"] = each
            for name, c in (("did", did), ("th", th), ("start", start)):
                of[name] = c[head[rest]]
            spread = join(did[rest].view(np.uint64), start[rest].astype(np.uint64)).view(np.int64)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer((np.arange(len(rest) + 1) * _COPY.itemsize).astype(np.int32).tobytes()), pa.py_buffer(of.tobytes())])
            yield pa.RecordBatch.from_arrays([*map(pa.array, (spread, did[rest], th[rest], start[rest], (-n).astype(np.int32))), packed], FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offs in slices(batch.column(2)):
                starts, ends, first = words(data, offs)
                hashes = word_hashes(data, starts, ends)
                at, place, gram = minimisers(hashes, first, length, routes.m)
                keep = has(routes.seen.value, gram[place])
                at, place = at[keep], place[keep]
                kinds = [(at, place, gram)]
                if routes.again is not None:
                    often = has(routes.hot.value, gram[place])
                    if often.any():
                        again = at[often]
                        again = again[has(routes.again.value, gram_hashes(hashes, first, length)[0][again])]
                        x, p, g = minimisers(hashes, first, length, wide)
                        kinds = [(at[~often], place[~often], gram), (again, p[np.searchsorted(x, again)], splitmix(g + np.uint64(1)))]
                row = row_of(first)
                symbols = _symbols(hashes)
                for k, (x, p, g) in enumerate(kinds):
                    if not len(x):
                        continue
                    lead = np.ones(len(x), bool)
                    lead[1:] = (p[1:] != p[:-1]) | (x[1:] != x[:-1] + 1)
                    s = x[lead]
                    e = x[np.append(np.flatnonzero(lead)[1:], len(x)) - 1] + length
                    r = row[s]
                    columns = [g[p[lead]].view(np.int64), did[lo:hi][r], th[lo:hi][r], (s - first[r]).astype(np.int32), (p[lead] - s).astype(np.int32)]
                    if not k:
                        yield _pack(columns, symbols, s, e)
                        continue
                    before = np.concatenate([[0], np.cumsum(e - s)])
                    held.append((*columns, symbols[np.repeat(s - before[:-1], e - s) + np.arange(before[-1])], e - s))
                    size += int(before[-1])
                    if size >= HELD:
                        yield from combined(held)
                        held, size = [], 0
        if held:
            yield from combined(held)

    return docs.select("did", "th", "text").mapInArrow(run, SEGMENT)


def copies(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
    """(the segments among rows SEGMENT, (did, th, start, number of windows, did, th, start and number of windows of the stand-in) of the copies)."""
    a = batch.column("a").to_numpy()
    rest = a < 0
    if not rest.any():
        z = np.zeros(0, np.int64)
        return batch, (z,) * 8
    part = batch.filter(pa.array(rest))
    of = np.frombuffer(b"".join(part.column("words").to_pylist()), _COPY)
    return batch.filter(pa.array(~rest)), (*(part.column(c).to_numpy() for c in ("did", "th", "start")), -a[rest], *(of[c] for c in _COPY.names))


def unpack_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all segments, offsets in words)."""
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]].reshape(-1, SYMBOL)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :SYMBOL] = raw
    return wide.view("<u8").ravel(), (o - o[0]) // SYMBOL


def shards(batches: Iterator[pa.RecordBatch], most_words: int) -> Iterator[pa.Table]:
    """Tables of whole groups of one g, of about `most_words` words, from batches sorted by g."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        sizes = np.diff(np.frombuffer(batch.column("words").buffers()[1], np.int32)[batch.column("words").offset :][: batch.num_rows + 1]) // SYMBOL
        if held and held[-1].column("g")[-1].as_py() != g[0] and size >= most_words:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        cuts = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        for c in cuts.tolist():
            if size + total[c] - total[at] >= most_words:
                held.append(batch.slice(at, c - at))
                if c < len(g):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                else:
                    size += total[c] - total[at]
                at = c
        if at < len(g):
            held.append(batch.slice(at))
            size += total[-1] - total[at]
    if held:
        yield pa.Table.from_batches(held)


def runs(did: np.ndarray, th: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each run's first window, its number of windows) for windows given in order; a run ends where a column of `same` changes too."""
    lead = np.ones(len(did), bool)
    if len(did) > 1:
        lead[1:] = (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1)
        for c in same:
            lead[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(lead)
    return at, np.diff(np.append(at, len(did)))
