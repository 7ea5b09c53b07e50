"""Substring dedup by FM-indexes of shards of repeated windows.

A window is `length` consecutive words of one document.  The words that are
covered by a window whose word sequence also starts earlier (smaller doc_id, or
same document and earlier start) go.  Windows that can repeat are routed by
their minimisers (see `anchors`); the segments of a few minimisers form a
shard.  Equal segments of a shard are indexed once, by the earliest; all windows
of the others are later ones.  A shard's text, the words of its different
segments with separators between, is sorted to the depth of a window; what stays
of that is its Burrows-Wheeler transform, in a wavelet matrix of packed bits with
counts for every 64 of them, and the earliest place of each repeated window.  The
segments are then streamed against it: from each window's end the backward search
goes on until the match is unique or as long as the threshold, all windows in
step; a match of full length reports the window if the earliest place of its
suffix interval precedes it.

Size: a minimiser's segments are bounded (those of frequent ones are split), so a
shard is, too.  Word symbols are 48 bits of a 64-bit hash: two windows that differ
in one word are taken for equal once in 2.8e14.

Defined results: a null text has no words; a null doc_id counts as the largest
and stays null in the result; rows with the same doc_id are ordered by the
window's start alone, so repeated rows don't remove each other's words and each
gets its result; texts of fewer words than a window lose none; an empty table
gives an empty table; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .anchors import HOT, NULL_ID, Routes, content, copies, keyed, runs, segments, shards, stand_ins, unpack_words
from .common import partitions, table
from .textkit import row_sums, slices, words

LENGTH, GRAM = 20, 6
SHARD_WORDS = 250_000


class WaveletMatrix:
    """Rank queries over a sequence of numbers: a packed bit vector for each bit of the numbers, highest first."""

    def __init__(self, values: np.ndarray, size: int) -> None:
        self.depth = max(1, int(size - 1).bit_length())
        self.zeros, self.words, self.counts = [], [], []
        v = values
        for level in range(self.depth - 1, -1, -1):
            bit = v >> level & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            w = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            c = np.zeros(len(w) + 1, np.int32)
            np.cumsum(np.bitwise_count(w), out=c[1:])
            self.words.append(w)
            self.counts.append(c)
            self.zeros.append(len(v) - int(bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])
        # where each number's run starts after all levels
        symbols = np.arange(size)
        self.base = self._walk(symbols, np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            block = at >> 6
            one = self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.depth - 1 - k) & 1, self.zeros[k] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of each symbol before the position."""
        return self._walk(symbol, at) - self.base[symbol]


class FMIndex:
    """Backward search for patterns of `depth` symbols in a text of numbers below `size`, whose separators and last symbol are 0.

    ``order`` is the rank of each place; of a repeated pattern the smallest rank is kept.
    """

    def __init__(self, text: np.ndarray, size: int, depth: int, order: np.ndarray) -> None:
        n = len(text)
        self.depth = depth
        rank, known = text.astype(np.int64), 1
        while True:
            step = min(known, depth - known)
            key = rank * (n + size + 1) + np.roll(rank, -step)
            known += step
            if known >= depth:
                break
            rank = np.unique(key, return_inverse=True)[1]
        suffix = np.argsort(key, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.wavelet = WaveletMatrix(text[suffix - 1].astype(np.int64), size)
        lead = np.flatnonzero(np.append(True, key[suffix][1:] != key[suffix][:-1]))
        earliest = np.minimum.reduceat(order[suffix], lead)
        twice = np.diff(np.append(lead, n)) > 1
        self.lows, self.earliest = lead[twice].astype(np.int32), earliest[twice]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of symbol + pattern from those of the patterns."""
        n = len(lo)
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.first[symbol], 2)
        return both[:n], both[n:]

    def repeats(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the windows text[at : at + depth] occur twice or more, the smallest rank of each one's places).

        The matching statistic of a window's end is cut short where the match is unique.
        """
        live = np.arange(len(at))
        c = text[at + self.depth - 1]
        lo, hi = self.first[c], self.first[c + 1]
        for k in range(self.depth - 2, -1, -1):
            more = hi - lo > 1
            live, lo, hi = live[more], lo[more], hi[more]
            if not len(live):
                break
            lo, hi = self.extend(text[at[live] + k], lo, hi)
        more = hi - lo > 1
        return live[more], self.earliest[np.searchsorted(self.lows, lo[more])]


def later_windows(shard: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(did, th, start) of a shard's windows that also start earlier, in order."""
    shard = shard.combine_chunks()
    did, th, start = (shard.column(c).to_numpy() for c in ("did", "th", "start"))
    symbols, offs = unpack_words(shard.column("words").chunk(0))
    head = stand_ins(*content(symbols, offs), did, start)
    own = np.flatnonzero(head == np.arange(len(head)))
    rest = np.flatnonzero(head != np.arange(len(head)))
    sizes = np.diff(offs)
    inside = np.repeat(head == np.arange(len(head)), sizes)
    n = sizes[own]
    ids = np.unique(symbols[inside], return_inverse=True)[1] + 1
    text = np.zeros(len(ids) + len(n), np.int32)
    text[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    # order of the places: by document, then by word
    owner = np.repeat(np.arange(len(n)), n + 1)
    lo = np.cumsum(n + 1) - (n + 1)
    word = np.arange(len(text)) - lo[owner] + start[own][owner]
    order = np.unique(did[own], return_inverse=True)[1][owner] * (int(word.max()) + 1) + word
    index = FMIndex(text, int(ids.max()) + 1, length, order)
    wins = np.flatnonzero(np.arange(len(text)) + length <= (lo + n)[owner])
    live, earliest = index.repeats(text, wins)
    at = wins[live][earliest < order[wins[live]]]
    # all windows of the segments that another stands for
    many = sizes[rest] - length + 1
    more = np.repeat(rest, many)
    place = np.arange(len(more)) - np.repeat(np.cumsum(many) - many, many) + start[more]
    d, t, s = np.concatenate([did[own][owner[at]], did[more]]), np.concatenate([th[own][owner[at]], th[more]]), np.concatenate([word[at], place])
    way = np.lexsort((s, t, d))
    return d[way], t[way], s[way]


FOUND = "did long, th long, start int, n int"


def repeated(docs: DataFrame, length: int = LENGTH, m: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(did, th, start, n): runs of windows that also start earlier, from `keyed` documents."""
    routes = Routes(docs, length, m, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late: list[tuple[np.ndarray, ...]] = []

        def rows(did: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(did), pa.array(th), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["did", "th", "start", "n"])

        def whole() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, copied = copies(batch)
                if len(copied[0]):
                    late.append(copied)
                yield own

        for shard in shards(whole(), shard_words):
            did, th, start = later_windows(shard, length)
            if len(did):
                at, n = runs(did, th, start)
                yield rows(did[at], th[at], start[at], n)
            while late:
                yield rows(*late.pop()[:4])
        while late:
            yield rows(*late.pop()[:4])

    return segments(docs, routes).repartition(partitions(docs.sparkSession), "g").sortWithinPartitions("g").mapInArrow(run, FOUND)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of each row; kept is the words left, joined by blanks."""
    source = keyed(docs, doc_id, text)
    spans = repeated(source, length, **options).groupBy("did", "th").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    joined = source.join(spans, ["did", "th"], "left").select("did", "text", "starts", "sizes")
    return joined.mapInArrow(_kept(length, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def _kept(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            ids = pa.array(ids, mask=ids == NULL_ID)
            for a, b, data, offs in slices(batch.column(1)):
                starts, ends, first = words(data, offs)
                marks, sizes = (c.slice(a, b - a) for c in (batch.column(2), batch.column(3)))
                row = np.repeat(np.arange(b - a), np.diff(marks.fill_null([]).offsets.to_numpy()) if marks.null_count < b - a else np.zeros(b - a, np.int64))
                at = marks.flatten().to_numpy() + first[row]
                n = sizes.flatten().to_numpy().astype(np.int64)
                d = np.zeros(len(starts) + 1, np.int64)
                np.add.at(d, at, 1)
                np.add.at(d, at + n + length - 1, -1)
                gone = np.cumsum(d[:-1]) > 0
                sha, kept = [], []
                removed = row_sums(gone.astype(np.int64), first)
                raw = data.tobytes()
                for i in range(b - a):
                    w = slice(first[i], first[i + 1])
                    left = ~gone[w]
                    out = b" ".join([raw[x:y] for x, y in zip(starts[w][left].tolist(), ends[w][left].tolist())])
                    sha.append(hashlib.sha256(out).hexdigest())
                    if keep_text:
                        kept.append((out if removed[i] else raw[offs[i] : offs[i + 1]]).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(first)), pa.array(removed), pa.array(sha)] + [pa.array(kept, pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    return run


def rewrite(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """The rows of docs, with all their columns, with the repeated words taken out of the text.

    A text that loses no word stays as it is; rows that lose all their words go.
    """
    spans = repeated(keyed(docs, doc_id, text), length, **options).groupBy("did", "th").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    key = [F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("th")]
    joined = docs.select(F.struct(*docs.columns).alias("row"), docs[text].cast("string").alias("text"), *key).join(spans, ["did", "th"], "left")
    work = _kept(length, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for done in work([pa.RecordBatch.from_arrays([batch.column(c) for c in ("did", "text", "starts", "sizes")], ["did", "text", "starts", "sizes"])]):
                n, gone = done.column("n_words").to_numpy(), done.column("n_removed").to_numpy()
                own = pa.array((gone == 0) | (gone < n))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(n)).filter(own), done.column("kept").filter(own), pa.array(gone > 0).filter(own)], ["row", "kept", "changed"])
                at += len(n)

    kind = docs.select(F.struct(*docs.columns).alias("row")).schema["row"].dataType.simpleString()
    out = joined.select("did", "text", "starts", "sizes", "row").mapInArrow(run, f"row {kind}, kept string, changed boolean")
    return out.select(*(F.when(F.col("changed"), F.col("kept")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
