"""Near-duplicate classes by Order MinHash.

A text's k-mers are its shingles of five words, each labelled with its
occurrence number, so repeats count.  A sketch takes the `ELL` labelled k-mers
with the smallest hashes and keeps them in text order, so two texts share it
only if they share those k-mers in the same order; the chance follows edit
similarity.  Every text of five words or more has `SKETCHES` of them.

A single edit spoils five shingles, which is much of a short text.  So texts of
10 to 96 words also have sketches of pairs of words, and texts of up to 14 words
have a key for each sequence that is left when as many words are deleted as the
threshold allows edits: two short texts within that distance have such a sequence
in common.  Two texts of like length are both short or both long in this sense.

Candidates are texts with an equal key.  Exact copies are one text first.  Keys
that one text only has are dropped by a bit filter of bounded size before texts
are dealt by key.  Each key's texts are a star around the smallest (a minimum
that is combined before the shuffle), so its links grow with its size, not with
its square.  Pairs whose lengths alone tell them apart go at once.  Every text is
aligned with its first candidate; then all other star links are, whose ends don't
have one centre by that.

Stars leave pairs out: those that are not with a centre, and those without a common
sketch.  So all pairs of texts in different classes are then searched exactly.  An
edit spoils three triples of words at most, so a near text has a number of them in
common (0.4 of the longer text's words, less two; shorter texts have pairs of words
or words, see `SIZES`).  Triples are dealt as 36 bits with 24 bits of their class;
those of several classes make a bit filter of bounded size, and only texts with
enough of them go on.  Texts that share a passage of half their words do, so among
those left the same is asked of pairs of words (0.6) and then of words (0.8), which
passages alone don't give.  The texts left are joined by their rarest words, as many
as a near text can't avoid (prefix filter: a fifth of them).  Two texts with one of
those in common, whose words' histograms differ by no more than the edits allowed,
are aligned.

Alignment is a unit-cost dynamic program over words in a band around the
diagonal, which is doubled until it holds the distance or is as wide as the
threshold allows, so near texts cost their length times their distance.  Texts
whose words or triples of words differ too much are told apart before, exactly:
an edit changes one word and three triples at most.  Similarity is
1 - distance / words of the longer text, and links need 0.8 or more.

Classes are components of the links, by repeated minimum over neighbours with
pointer jumping, on tables in the shared checkpoint folder; nothing but counts
and the bit filter reaches the driver.

Defined results: a null text is the empty text; texts with the same words are in
one class, so all texts without words are; repeated rows give a row each; a null
doc_id stays null and counts as the largest; an empty table gives an empty table;
other columns are ignored; texts of any length are sketched and aligned whole.
The class id is its smallest doc_id.  Texts are known by 64-bit hashes: among
10**10 different ones some three pairs would share one.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .anchors import LEAST_BITS, MOST_BITS, bit_filter, has
from .common import discard, durable, fetched, partitions, small_batches, table
from .textkit import gram_hashes, join, row_of, row_sums, slices, splitmix, utf8, word_hashes, words

SHINGLE, ELL, SKETCHES = 5, 2, 80
#: Texts of so many words have sketches of pairs of words, too: so many of them.
PAIRED, PAIR_SKETCHES = (10, 96), 16
#: Texts of up to so many words have a key for each sequence left by deletions.
DELETED = 14
#: Grams of the exact search: (least and most words of the longer text, words of a gram).
SIZES = ((1, 4, 1), (5, DELETED, 2), (DELETED + 1, 1 << 40, 3))
#: Words of a gram in the later rounds, among the texts left.
ROUNDS = (2, 1)
#: The first round is repeated while it leaves at most this share of the texts.
HELPED = 0.9
#: Bits of a gram's group (of few letters, of more than FEW), of the whole gram and of its class that are dealt, and grams that a task holds.
GROUP_BITS, GRAM_BITS, CLASS_BITS, HELD = (4, 12), 36, 24, 1 << 20
FEW = 1 << 24
#: Texts that are copied at once.
TAKEN = 512
#: Words of a text's beginning that come along with each of the later ones.
BEFORE = 128
#: Pairs of two classes, those of the most similar histograms, that are aligned before all others.
FIRST = 3
#: Bins of a text's histogram of words, half a byte each.
BINS = 256
SIMILARITY = 0.8
NULL_ID = (1 << 63) - 1
#: Cells of the alignment matrix worked on at once, and narrowest band.
CELLS, NARROW = 1 << 14, 6
#: Bytes of candidate pairs that are compared at once.
COMPARED = 1 << 22


def labelled(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of each value with its occurrence number in its row, in order."""
    number = np.zeros(len(values), np.uint64)
    # few occur again in their row, and only those are ordered by row and place
    key = join(values, row.astype(np.uint64))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(values), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    some = np.flatnonzero(again)
    if len(some):
        order = np.lexsort((values[some], row[some]))
        v, r, at = values[some][order], row[some][order], np.arange(len(some))
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        number[some[order]] = at - np.maximum.accumulate(np.where(new, at, 0))
    return splitmix(values + number * np.uint64(0x9E3779B97F4A7C15))


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; `np.unique` of numbers is many times slower."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def _kmers(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(labelled k-mers of all rows, row table of them)."""
    gram, ok = gram_hashes(hashes, first, k)
    size = np.maximum(np.diff(first) - k + 1, 0)
    return labelled(gram[ok], np.repeat(np.arange(len(size)), size)), np.concatenate([[0], np.cumsum(size)])


def sketch(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE, sketches: int = SKETCHES, ell: int = ELL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have a k-mer, rows x sketches hashes of their ordered smallest labelled k-mers, rows x sketches x ell first words of those or -1)."""
    value, lo = _kmers(hashes, first, k)
    rows = np.flatnonzero(np.diff(lo))
    out, words_of = np.empty((len(rows), sketches), np.uint64), np.empty((len(rows), sketches, ell), np.int64)
    if not len(rows):
        return rows, out, words_of
    heads = lo[rows]
    place = (np.arange(len(value)) - np.repeat(heads, np.diff(lo)[rows])).astype(np.uint64)  # a text has fewer than 2**24 words
    low, most = np.uint64((1 << 24) - 1), np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.empty_like(value)
    for s in range(sketches):
        np.multiply(value, splitmix(np.array([k << 32 | s], np.uint64))[0] | np.uint64(1), out=h)
        np.bitwise_and(h, ~low, out=h)
        np.bitwise_or(h, place, out=h)
        picked = np.empty((ell, len(rows)), np.int64)
        for j in range(ell):
            least = np.minimum.reduceat(h, heads)
            at = heads + (least & low).astype(np.int64)
            picked[j] = np.where(least == most, -1, at)
            h[at[least != most]] = most
        picked.sort(axis=0)
        key = np.full(len(rows), k << 32 | s, np.uint64)
        for p in picked:
            key = join(key, np.where(p >= 0, value[np.maximum(p, 0)], np.uint64(7)))
        out[:, s] = key
        words_of[:, s] = np.where(picked >= 0, picked - heads + first[rows], -1).T
    return rows, out, words_of


@lru_cache(maxsize=64)
def _kept(n: int, deletions: int) -> list[np.ndarray]:
    """Places left after 0 to `deletions` deletions from n words, a table for each number."""
    left = [list(combinations(range(n), n - d)) for d in range(deletions + 1)]
    return [np.array(x, np.int64).reshape(len(x), n - d) for d, x in enumerate(left)]


def deletion_keys(hashes: np.ndarray, first: np.ndarray, similarity: float = SIMILARITY, most: int = DELETED) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the sequences left of texts of at most `most` words by as many deletions as edits are allowed between two such texts."""
    size = np.diff(first)
    rows, keys = [], []
    for n in range(most + 1):
        own = np.flatnonzero(size == n)
        if not len(own):
            continue
        w = hashes[first[own][:, None] + np.arange(n)]
        for kept in _kept(n, band(min(most, int(n / similarity + 1e-9)), 0, similarity)):
            h = np.full((len(own), len(kept)), kept.shape[1] + 1, np.uint64)
            for c in kept.T:
                h = join(h, w[:, c])
            rows.append(np.repeat(own, len(kept)))
            keys.append(h.ravel())
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def _sketches(hashes: np.ndarray, first: np.ndarray, sketches: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, key, first words of its k-mers, k) of the sketches of shingles and, for texts that are not long, of pairs of words."""
    n = np.diff(first)
    some = (n >= PAIRED[0]) & (n <= PAIRED[1])
    names, inside = np.flatnonzero(some), np.flatnonzero(np.repeat(some, n))
    rows, keys, at = sketch(hashes, first, SHINGLE, sketches)
    out = [(np.repeat(rows, sketches), keys.ravel(), at.reshape(-1, ELL), SHINGLE)]
    rows, keys, at = sketch(hashes[inside], np.concatenate([[0], np.cumsum(n[some])]), 2, PAIR_SKETCHES)
    at = np.where(at >= 0, np.append(inside, -1)[at], -1)
    return [*out, (np.repeat(names[rows], PAIR_SKETCHES), keys.ravel(), at.reshape(-1, ELL), 2)]


def _by_row(parts: list[tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row table) of parts (row, key)."""
    row, key = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(row, kind="stable")
    return key[order], np.searchsorted(row[order], np.arange(rows + 1))


def all_keys(data: np.ndarray, offs: np.ndarray, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of all rows one after the other, row table of them, words of each row)."""
    starts, ends, first = words(data, offs)
    hashes = word_hashes(data, starts, ends)
    parts = [deletion_keys(hashes, first, similarity), *(p[:2] for p in _sketches(hashes, first, sketches))]
    return *_by_row(parts, len(offs) - 1), np.diff(first)


def band(a: int, b: int, similarity: float = SIMILARITY) -> int:
    """Largest distance that the similarity allows for texts of a and b words."""
    return int((1 - similarity) * max(a, b) + 1e-9)


def _shared(one: np.ndarray, one_first: np.ndarray, two: np.ndarray, two_first: np.ndarray) -> np.ndarray:
    """Values that the left and the right row of each pair have in common, repeats counted."""
    left, right = (join(labelled(v, row_of(f)), row_of(f).astype(np.uint64)) for v, f in ((one, one_first), (two, two_first)))
    return row_sums(np.isin(left, right).astype(np.int64), one_first)


def _grams(values: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    gram, ok = gram_hashes(values, first, n)
    return gram[ok], np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - n + 1, 0))])


def _some(values: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows picked, as values and row table."""
    size = np.diff(first)[pick]
    before = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(first[:-1][pick] - before[:-1], size) + np.arange(before[-1])], before


def least_common(n: np.ndarray, lo: int, hi: int, k: int, similarity: float = SIMILARITY) -> np.ndarray:
    """Grams of k words that a text of n words has in common at least with any near one, the longer of both having lo to hi words; NULL_ID if none can."""
    out, m = np.full(len(n), NULL_ID), np.maximum(n, lo)
    # further on it only grows: a period of the largest distance adds more grams than its one edit spoils
    for _ in range(int(1 / max(1 - similarity, 1e-3)) + 2):
        ok = (m <= hi) & (similarity * m <= n + 1e-6)
        out = np.where(ok, np.minimum(out, m - (k - 1) - k * ((1 - similarity) * m + 1e-9).astype(np.int64)), out)
        m = m + 1
    return out


def _sizes(similarity: float) -> tuple[tuple[int, int, int], ...]:
    return SIZES if similarity >= SIMILARITY else ((1, 1 << 40, 1),)


def _exact(hashes: np.ndarray, first: np.ndarray, similarity: float, sizes: tuple[tuple[int, int, int], ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words of a gram, rows, their labelled grams, row table of those, how many a near text has in common at least)."""
    n = np.diff(first)
    for lo, hi, k in sizes:
        least = least_common(n, lo, hi, k, similarity)
        rows = np.flatnonzero((n > 0) & (least < NULL_ID))
        if len(rows):
            yield k, rows, *_kmers(*_some(hashes, first, rows), k), least[rows]


def _dealt(held: list[np.ndarray], group_bits: int) -> pa.RecordBatch:
    """(part, pieces): grams and classes, sorted, as whole bytes each without their group."""
    v = _distinct(np.concatenate(held))
    part = (v >> np.uint64(GRAM_BITS + CLASS_BITS - group_bits)).astype(np.int32)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    size = (GRAM_BITS + CLASS_BITS - group_bits) // 8
    packed = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :size])
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(at, len(v)) * size).astype(np.int32)), pa.py_buffer(packed)])
    return pa.RecordBatch.from_arrays([pa.array(part[at]), pieces], ["part", "pieces"])


def _known(batches: Iterator[pa.RecordBatch], known, wanted: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose first column passes the filter, or those that don't, a few texts at a time."""
    for batch in batches:
        ok = pa.array(has(known.value, batch.column(0).to_numpy().view(np.uint64)) == wanted)
        for at in range(0, len(batch), TAKEN):
            yield batch.slice(at, TAKEN).filter(ok.slice(at, TAKEN))


class FarGrams:
    """The grams that texts of several classes have, as a bit filter that is broadcast; few others pass.  With ranks there is a byte for a bit, that grows with their classes.

    rooted has (root, text); alone, if given, (t, text) that are a class of their own each, but for those in the filter `known` of t.
    """

    def __init__(self, rooted: DataFrame, letters: int, similarity: float, sizes: tuple[tuple[int, int, int], ...], alone: DataFrame | None = None, known=None, ranks: bool = False) -> None:
        self.similarity, self.sizes, self.ranks = similarity, sizes, ranks
        # all texts: a bit or two a gram; the texts left: a dozen bits or a byte or two
        self.group_bits = group_bits = GROUP_BITS[int(letters > FEW)]
        self.bits = bits = min(MOST_BITS - 3 * ranks, max(LEAST_BITS, (letters // 4 if ranks or alone is not None else 2 * letters).bit_length()))
        size = (GRAM_BITS + CLASS_BITS - group_bits) // 8

        def run(batches: Iterator[pa.RecordBatch], known=None) -> Iterator[pa.RecordBatch]:
            held = []
            for batch in batches if known is None else _known(batches, known, False):
                for lo, hi, data, offs in slices(batch.column(1)):
                    starts, ends, first = words(data, offs)
                    root = splitmix(batch.column(0).to_numpy()[lo:hi].view(np.uint64)) >> np.uint64(64 - CLASS_BITS)
                    for _, rows, grams, own, _ in _exact(word_hashes(data, starts, ends), first, similarity, sizes):
                        held.append(grams >> np.uint64(64 - GRAM_BITS) << np.uint64(CLASS_BITS) | root[rows][row_of(own)])
                    if sum(map(len, held)) >= HELD:
                        yield _dealt(held, group_bits)
                        held = []
            if sum(map(len, held)):
                yield _dealt(held, group_bits)

        def several(group: pa.Table) -> pa.Table:
            raw = np.frombuffer(b"".join(group.column("pieces").to_pylist()), np.uint8).reshape(-1, size)
            v = np.zeros((len(raw), 8), np.uint8)
            v[:, :size] = raw
            g = _distinct(v.view(np.uint64).ravel()) >> np.uint64(CLASS_BITS)
            # the group's own bits are not among these
            at = np.append(np.flatnonzero(np.diff(g, prepend=g[:1] + np.uint64(1))), len(g))
            classes = np.diff(at)
            again, classes = g[at[:-1]][classes > 1], classes[classes > 1]
            chunk = np.zeros(1 << bits - group_bits, np.uint8)
            if ranks:
                np.maximum.at(chunk, again >> np.uint64(GRAM_BITS - bits), np.minimum(8 * np.log2(classes), 255).astype(np.uint8))
            else:
                chunk[again >> np.uint64(GRAM_BITS - bits)] = chunk[again & np.uint64(len(chunk) - 1)] = 1
            return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([(chunk if ranks else np.packbits(chunk, bitorder="little")).tobytes()], pa.binary())})

        dealt = rooted.select("root", "text").mapInArrow(run, "part int, pieces binary")
        if alone is not None:
            dealt = dealt.unionByName(alone.select("t", "text").mapInArrow(lambda batches: run(batches, known), "part int, pieces binary"))
        out = np.zeros(1 << bits - 3 * (not ranks), np.uint8)
        bytes_ = len(out) >> group_bits
        for r in fetched(dealt.groupBy("part").applyInArrow(several, "part int, bits binary")):
            out[r.part * bytes_ : (r.part + 1) * bytes_] = np.frombuffer(r.bits, np.uint8)
        self.seen = rooted.sparkSession.sparkContext.broadcast(out)

    def passed(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their labelled grams, row table of those, rank of each or 0 if it does not pass, how many a near text has in common at least) for each of the sizes."""
        for _, rows, grams, own, least in _exact(hashes, first, self.similarity, self.sizes):
            yield rows, grams, own, self._rank(grams), least

    def _rank(self, grams: np.ndarray) -> np.ndarray:
        """Rank of each labelled gram, or 0 if it does not pass; without ranks a gram has two bits in its group's chunk, of its first and of its last letters."""
        slot = grams >> np.uint64(64 - self.bits)
        if self.ranks:
            return self.seen.value[slot]
        inside = np.uint64((1 << self.bits - self.group_bits) - 1)
        bit = lambda at: self.seen.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        return bit(slot) & bit(slot & ~inside | grams >> np.uint64(64 - GRAM_BITS) & inside)

    def lengths(self, first: np.ndarray) -> list[int]:
        """Words of a gram for each of the sizes that `passed` gives."""
        n = np.diff(first)
        return [k for lo, hi, k in self.sizes if ((n > 0) & (least_common(n, lo, hi, k, self.similarity) < NULL_ID)).any()]

    def _explained(self, hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
        """Whether as many edits as a near text allows can have spoiled all grams of a row that no other class has.

        An edit spoils grams that overlap only, so scattered ones need more edits than a kth of their number.  A gram whose first
        occurrence passes counts as shared wherever it stands, as a near text may have fewer of them.
        """
        n, (gram, own) = np.diff(first), _grams(hashes, first, k)
        unlike = self._rank(splitmix(gram)) == 0
        at, row = np.flatnonzero(unlike), row_of(own)[unlike]
        d = 1 - self.similarity
        # a longer near text has words put in, each of which spoils a gram less
        longer = n * (1 / self.similarity - 1)
        if k * d < 1:
            longer = np.minimum(longer, (k * d * n - row_sums(unlike.astype(np.int64), own)) / (1 - k * d))
        return least_points(at, row, len(n), k) <= d * (n + longer) + 1e-6

    def enough(self, texts: DataFrame) -> DataFrame:
        """The rows of texts (its column text) that have as many such grams as a near text of another class asks for."""
        place = texts.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offs in slices(batch.column(place)):
                    starts, ends, first = words(data, offs)
                    ok, hashes = np.zeros(hi - lo, bool), word_hashes(data, starts, ends)
                    for (rows, _, own, rank, least), k in zip(self.passed(hashes, first), self.lengths(first)):
                        rows = rows[row_sums((rank > 0).astype(np.int64), own) >= least]
                        ok[rows[self._explained(*_some(hashes, first, rows), k)]] = True
                    if ok.any():
                        yield batch.slice(lo, hi - lo).filter(pa.array(ok))

        return texts.mapInArrow(run, texts.schema)


def least_points(at: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Fewest points of each row such that each of its intervals, k places from `at` (sorted) on, holds one."""
    none = len(at)
    after = np.searchsorted(at, at + k)
    after = np.append(np.where(row[np.minimum(after, none - 1)] == row, after, none), none) if none else np.zeros(1, np.int64)
    points = np.append(np.ones(none, np.int64), 0)
    # each doubling goes twice as far along the chain of leftmost intervals not yet held
    while (after < none).any():
        points, after = points + points[after], after[after]
    heads = np.searchsorted(row, np.arange(rows + 1))
    return np.where(np.diff(heads) > 0, points[np.minimum(heads[:-1], none)], 0)


def histograms(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows x BINS / 2 bytes: the words of each bin, 15 at most, two bins a byte."""
    n = len(first) - 1
    bins = np.bincount(row_of(first) * BINS + (hashes >> np.uint64(56)).astype(np.int64) % BINS, minlength=n * BINS).reshape(n, BINS)
    low = np.minimum(bins, 15).astype(np.uint8)
    return low[:, ::2] | low[:, 1::2] << 4


def least_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits that two texts' histograms differ by at least: one takes a word from a bin and puts one into another at most."""
    d = [(a >> s & 15).astype(np.int16) - (b >> s & 15) for s in (0, 4)]
    return np.maximum(sum(np.maximum(x, 0).sum(1) for x in d), sum(np.maximum(-x, 0).sum(1) for x in d))


def far_texts(rows: DataFrame, label: DataFrame, similarity: float) -> tuple[DataFrame, FarGrams | None]:
    """(t, root, text) of the texts of (t, text) that may have a near one in another class by label (node, root), and the last round's grams; None if no text is left."""
    spark = rows.sparkSession
    roots = label.withColumnRenamed("node", "t")
    size = min(MOST_BITS, max(LEAST_BITS, (16 * label.count()).bit_length()))
    known = spark.sparkContext.broadcast(bit_filter(label.select(F.col("node").alias("g"), F.lit(1).alias("n")), 1, size))

    def rooted(some: DataFrame) -> DataFrame:
        return some.join(roots, "t", "left").select("t", F.coalesce("root", "t").alias("root"), "text")

    letters = lambda df: df.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = rows.select("t", "text")
    # only texts that have a label are dealt to get it
    far = FarGrams(rooted(texts.mapInArrow(lambda batches: _known(batches, known, True), texts.schema)), letters(rows), similarity, _sizes(similarity), texts, known)
    left, before = durable(rooted(far.enough(texts).dropDuplicates(["t"]))), None
    # in a large corpus many grams are in some other text by chance, in fewer of those left: the first round goes on as long as it helps
    rounds = [None, *ROUNDS]
    while rounds:
        many = left.count()
        if not many:
            return left, None
        if before is not None and many > HELPED * before:
            rounds.pop(0)
        last, before = left, None if rounds[0] else many
        sizes = ((1, 1 << 40, rounds[0]),) if rounds[0] else _sizes(similarity)
        far = FarGrams(left, letters(left), similarity, sizes, ranks=rounds[0] == ROUNDS[-1])
        left = durable(far.enough(left))
        discard(last)
        if rounds[0]:
            rounds.pop(0)
    return left, far


def far_pairs(left: DataFrame, far: FarGrams, similarity: float) -> DataFrame:
    """(a, b, rank): all pairs of near texts in different classes among `far_texts`, and few others; rank numbers those of two classes, likely ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(2)):
                starts, ends, first = words(data, offs)
                hashes = word_hashes(data, starts, ends)
                for own_rows, grams, own, rank, least in far.passed(hashes, first):
                    ok, size = rank > 0, row_sums((rank > 0).astype(np.int64), own)
                    row = row_of(own)[ok]
                    order = np.lexsort((grams[ok], rank[ok], row))
                    # of what two near texts have in common each one's last least - 1 may be cut off, so one is in both beginnings
                    head = np.maximum(size - least + 1, 0)
                    row, grams = row[order], grams[ok][order]
                    at = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(head)]).astype(np.int32)), pa.array(grams[at < head[row]].view(np.int64)))
                    t, root = (batch.column(c).slice(lo, hi - lo).take(pa.array(own_rows)) for c in (0, 1))
                    bins = pa.array([x.tobytes() for x in histograms(*_some(hashes, first, own_rows))], pa.binary())
                    yield pa.RecordBatch.from_arrays([t, root, pa.array(np.diff(first)[own_rows]), pa.array(size), bins, lists], ["t", "root", "n", "size", "bins", "head"])

    def like_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS // 2) for c in (3, 4))
            edits, longer = least_edits(left, right), batch.column(2).to_numpy()
            ok = pa.array(edits <= (1 - similarity) * longer + 1e-9)
            columns = [*(batch.column(c) for c in (0, 1, 5, 6)), pa.array(edits / longer)]
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in columns], ["a", "b", "lo", "hi", "unlike"])

    listed = durable(left.mapInArrow(run, "t long, root long, n long, size long, bins binary, head array<long>"))
    placed = listed.select("t", "root", "n", "size", "head", F.posexplode("head").alias("i", "g"))
    # most pairs have several: those before each come along, and a pair that has one of them is left to that one
    heads = durable(placed.select("t", "root", "n", "g", (F.col("size") - F.col("i")).alias("rest"), F.slice("head", F.lit(1), F.least(F.col("i"), F.lit(BEFORE))).alias("before")))
    other = heads.select("g", *(F.col(c).alias(f"{c}2") for c in ("t", "n", "root", "rest", "before")))
    longer = F.greatest("n", "n2")
    # the first that two texts have in common is followed by all others in both
    like = (F.least("n", "n2") + 1e-6 >= similarity * longer) & (F.least("rest", "rest2") >= longer - F.floor((1 - similarity) * longer + 1e-9))
    first = ~F.arrays_overlap("before", "before2")
    # few bytes, but many pairs come of them: without dealing a handful of tasks would do all
    both = heads.repartition(partitions(left.sparkSession), "t").join(other, "g").where((F.col("t") < F.col("t2")) & (F.col("root") != F.col("root2")) & like & first)
    met = both.select(F.col("t").alias("a"), F.col("t2").alias("b"), longer.alias("longer"), F.least("root", "root2").alias("lo"), F.greatest("root", "root2").alias("hi")).distinct()
    bins = listed.select("t", "bins")
    met = met.join(bins.withColumnsRenamed({"t": "a", "bins": "left"}), "a").join(bins.withColumnsRenamed({"t": "b", "bins": "right"}), "b")
    like = met.select("a", "b", "longer", "left", "right", "lo", "hi").mapInArrow(like_bins, "a long, b long, lo long, hi long, unlike double")
    out = durable(like.select("a", "b", F.row_number().over(Window.partitionBy("lo", "hi").orderBy("unlike", "a", "b")).alias("rank")))
    discard(listed, heads)
    return out


def distances(left: np.ndarray, left_first: np.ndarray, right: np.ndarray, right_first: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Edit distance over words of each pair of rows (word hashes and row tables), or -1 if it exceeds the pair's band."""
    la, lb = np.diff(left_first), np.diff(right_first)
    longer = np.maximum(la, lb)
    width = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    out = np.full(len(la), -1, np.int64)
    live = np.flatnonzero(np.abs(la - lb) <= width)
    least = np.abs(la - lb)
    # an edit changes one word and at most n grams of n words
    for n in (1, 3):
        a, b = _some(left, left_first, live), _some(right, right_first, live)
        missing = longer[live] - (n - 1) - _shared(*_grams(*a, n), *_grams(*b, n))
        least[live] = np.maximum(least[live], -(-missing // n))
        live = live[least[live] <= width[live]]
    now = np.minimum(width[live], np.maximum(2 * least[live], NARROW))
    # a common beginning and end cost nothing
    at_left, at_right, la, lb = left_first[:-1].copy(), right_first[:-1].copy(), la.copy(), lb.copy()
    for i in live.tolist():
        for way in (1, -1):
            a, b = left[at_left[i] : at_left[i] + la[i]][::way], right[at_right[i] : at_right[i] + lb[i]][::way]
            m = min(len(a), len(b))
            unlike = a[:m] != b[:m]
            same = int(unlike.argmax()) if unlike.any() else m
            la[i], lb[i] = la[i] - same, lb[i] - same
            if way > 0:
                at_left[i], at_right[i] = at_left[i] + same, at_right[i] + same
    while len(live):
        order = np.lexsort((la[live], now))
        live, now = live[order], now[order]
        got = np.full(len(live), -1, np.int64)
        at = 0
        while at < len(live):
            end = at + 1
            while end < len(live) and (end + 1 - at) * (2 * now[end] + 1) <= CELLS and (end + 1 - at) * (la[live[end]] + 2 * now[end]) <= 16 * CELLS and now[end] <= 1.3 * now[at] + 2:
                end += 1
            part = live[at:end]
            texts = [[v[f[i] : f[i] + n[i]] for i in part.tolist()] for v, f, n in ((left, at_left, la), (right, at_right, lb))]
            got[at:end] = _aligned(*texts, now[at:end])
            at = end
        out[live] = got
        more = (got < 0) & (now < width[live])
        live, now = live[more], np.minimum(width[live][more], 2 * now[more])
    return out


def _aligned(left: list[np.ndarray], right: list[np.ndarray], width: np.ndarray) -> np.ndarray:
    """Banded unit-cost alignment, row by row for all pairs; column c of a row i stands for place i + c - w of the right text."""
    w, p = int(width.max()), len(left)
    la, lb = np.array([len(a) for a in left]), np.array([len(b) for b in right])
    rows = int(la.max())
    far = np.int32(1 << 28)
    # right texts, shifted by w, with codes that match nothing around them
    ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1].astype(np.int32)
    cut = np.cumsum([len(x) for x in (*left, *right)])[:-1]
    coded = np.split(ids, cut)
    r = np.full((p, rows + 2 * w + 2), -1, np.int32)
    l = np.full((p, rows), -2, np.int32)
    for i in range(p):
        l[i, : la[i]] = coded[i]
        r[i, w : w + min(lb[i], rows + w + 2)] = coded[p + i][: rows + w + 2]
    c = np.arange(2 * w + 1, dtype=np.int32)
    d = np.where(c >= w, c - w, far)[None, :].repeat(p, 0).astype(np.int32)  # row 0: insertions only
    d[c[None, :] - w > lb[:, None]] = far
    out = np.full(p, -1, np.int64)
    done = la == 0
    out[done] = lb[done]
    for i in range(1, rows + 1):
        cost = (r[:, i - 1 : i + 2 * w] != l[:, i - 1 : i]).astype(np.int32)
        t = d + cost
        t[:, :-1] = np.minimum(t[:, :-1], d[:, 1:] + 1)
        if i <= w:
            t[:, : w - i] = far
            t[:, w - i] = i
        t -= c
        np.minimum.accumulate(t, axis=1, out=t)
        d = t + c
        if i % 16 == 0 and (d.min(axis=1) > width).all():
            break  # it only grows
        for j in np.flatnonzero(la == i):
            k = lb[j] - i + w
            if 0 <= k <= 2 * w:
                out[j] = d[j, k]
    return np.where((out >= 0) & (out <= width), out, -1)


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b) the smallest of its component.

    Each round every node takes the smallest root among its neighbours' and then
    that node's own root (pointer jumping); rounds go on until no root changes.
    """
    both = durable(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).where("node <> other").distinct())
    root = durable(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("root")))
    while True:
        near = both.join(root.select(F.col("node").alias("other"), F.col("root").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        # the old root is told of its node's new one, too
        step = root.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        told = step.where("new < root").groupBy(F.col("root").alias("node")).agg(F.min("new").alias("told"))
        step = step.join(told, "node", "left").select("node", "root", F.least("new", F.coalesce("told", "new")).alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("next"))
        new = durable(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("next", "new")).alias("root"), (F.col("root") > F.col("new")).alias("moved")))
        root = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return root


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(did, t, text): t is a hash of the text."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(body).alias("t"), body.alias("text"))


def stars(rows: DataFrame, similarity: float, sketches: int) -> DataFrame:
    """(key, a, an, t, n) of the keys that several texts have: the smallest of them and each of them, with their numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                keys, first, n = all_keys(data, offs, similarity, sketches)
                t, own = np.unique(batch.column(0).to_numpy()[lo:hi], return_index=True)
                keys, first = _some(keys, first, own)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n[own].astype(np.int32)), lists], ["t", "n", "keys"])

    sketched = durable(rows.select("t", "text").mapInArrow(run, "t long, n int, keys array<long>"))
    out = _repeated(sketched)
    discard(sketched)
    return out


def _repeated(sketched: DataFrame) -> DataFrame:
    """Stars of the keys in (t, n, keys)."""
    again = durable(sketched.select("t", F.explode("keys").alias("g")).groupBy("g").agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a <> z").select("g", "a", F.lit(2).alias("n")))
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * again.count()).bit_length()))
    seen = sketched.sparkSession.sparkContext.broadcast(bit_filter(again, 2, bits))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            keys, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            ok = has(seen.value, keys.view(np.uint64))
            own = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), batch.column(0).take(own), batch.column(1).take(own)], ["key", "t", "n"])

    mine = sketched.select("t", "n", "keys").mapInArrow(shared, "key long, t long, n int")
    mine = mine.join(again.select(F.col("g").alias("key"), "a"), "key").distinct()
    out = durable(mine.join(mine.where("a = t").select("key", F.col("n").alias("an")), "key"))
    discard(again)
    return out


def _labelled(rows: DataFrame, similarity: float, sketches: int) -> DataFrame:
    """(t, root) of the texts that have a near one: the smallest text of its class."""
    star = stars(rows, similarity, sketches)
    text_of = durable(rows.select("t", "text").join(star.select("t").distinct(), "t", "left_semi").dropDuplicates(["t"]))

    def candidates(star: DataFrame) -> DataFrame:
        """The different star links whose ends may be near by their lengths."""
        like = F.least("n", "an") + 1e-6 >= similarity * F.greatest("n", "an")
        return star.where((F.col("a") < F.col("t")) & like).select("a", F.col("t").alias("b")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(np.diff(utf8(batch.column(c))[1]) for c in (2, 3))
            cuts = np.searchsorted(np.cumsum(size), np.arange(COMPARED, int(size.sum()) + COMPARED, COMPARED))
            at = 0
            for end in np.unique(np.minimum(cuts + 1, len(size))).tolist():
                part = batch.slice(at, end - at)
                at = end
                sides = []
                for c in (2, 3):
                    hashes, counts = [], []
                    for _, _, data, offs in slices(part.column(c)):
                        s, e, first = words(data, offs)
                        hashes.append(word_hashes(data, s, e))
                        counts.append(np.diff(first))
                    sides += [np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])]
                ok = pa.array(distances(*sides, similarity) >= 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    def aligned(wanted: DataFrame, text_of: DataFrame = text_of) -> DataFrame:
        with_texts = wanted.join(text_of.withColumnsRenamed({"t": "b", "text": "right"}), "b").join(text_of.withColumnsRenamed({"t": "a", "text": "left"}), "a")
        return durable(with_texts.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long"))

    def apart(wanted: DataFrame, label: DataFrame) -> DataFrame:
        """The pairs whose ends are in different classes."""
        for c in ("a", "b"):
            wanted = wanted.join(label.withColumnsRenamed({"node": c, "root": f"{c}_root"}), c, "left")
        return durable(wanted.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))

    pairs = candidates(star)
    turn = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    linked = aligned(turn)
    rest = apart(pairs.join(turn, ["a", "b"], "left_anti"), linked.select(F.col("b").alias("node"), F.col("a").alias("root")))
    if rest.limit(1).count():
        linked = linked.unionByName(aligned(rest))
    label = components(linked)
    discard(star, text_of, rest)
    left, far = far_texts(rows, label, similarity)
    if far is not None:
        wanted, whole = far_pairs(left, far, similarity), left.select("t", "text")
        # most classes that belong together are one by their likeliest pairs, and their other pairs are not aligned
        for some in (wanted.where(F.col("rank") <= FIRST), wanted.where(F.col("rank") > FIRST)):
            found = aligned(apart(some.select("a", "b"), label).repartition(partitions(rows.sparkSession), "a", "b"), whole)
            if found.limit(1).count():
                linked = linked.unionByName(found)
                label = components(linked)
    return label.withColumnRenamed("node", "t")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """(doc_id, class_id) of every row: near-duplicate classes by edit similarity over words."""
    rows = _texts(docs, doc_id, text)
    class_of = _classes(rows, similarity, sketches).select("t", F.col("first.did").alias("class_id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return rows.select("did", "t").join(class_of, "t").select(real("did").alias("doc_id"), real("class_id").alias("class_id"))


def _classes(rows: DataFrame, similarity: float, sketches: int) -> DataFrame:
    """(t, first) of every different text: the smallest (did, t) of its class."""
    with small_batches(rows.sparkSession):
        label = _labelled(rows, similarity, sketches)
    owner = rows.groupBy("t").agg(F.min("did").alias("did"), (F.count(F.lit(1)) > 1).alias("again"))
    own = durable(owner.join(label, "t", "left").select("t", "did", F.coalesce("root", "t").alias("root"), (F.col("again") | F.col("root").isNotNull()).alias("several")))
    first = own.groupBy("root").agg(F.min("did").alias("did")).join(own.select("root", "did", "t"), ["root", "did"]).groupBy("root").agg(F.min("t").alias("t"), F.min("did").alias("did"))
    return own.select("t", "root", "several").join(first.select("root", F.struct("did", "t").alias("first")), "root").select("t", "first", "several")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """One whole row of docs for each class: that of the smallest doc_id (then text key); of repeated rows any one."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    classes = durable(_classes(_texts(docs, doc_id, text), similarity, sketches))
    several = classes.where("several").select(F.col("t").alias("g"), F.lit(1).alias("n"))
    known = docs.sparkSession.sparkContext.broadcast(bit_filter(several, 1, min(MOST_BITS, max(LEAST_BITS, (16 * several.count()).bit_length()))))
    whole = docs.select(F.xxhash64(body).alias("t"), F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("did"), F.struct(*docs.columns).alias("row"))
    chosen = classes.where("t = first.t").select("first.t", "first.did")
    some = lambda df, wanted: df.mapInArrow(lambda batches: _known(batches, known, wanted), df.schema)
    # a row without copies or near ones stays, only others are dealt
    return some(whole, False).unionByName(some(whole, True).join(some(chosen, True), ["did", "t"], "left_semi").dropDuplicates(["did", "t"])).select("row.*")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
