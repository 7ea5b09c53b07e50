"""Two-bit codes of k-mers, made from whole pieces of sequences at once.

A k-mer of k <= 31 bases is a long, first base highest, so codes of bases are in the order of the strings.
Sequences come as pieces (`genome.chunks`), so no row has to hold a chromosome; k-mers with other characters are never codes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as fn
from ..tables import fetched
from . import genome as gn

#: Bases of a k-mer that a code can hold; longer ones stay strings.
MOST = 31
#: Bases a piece, and bases worked on at once.
PIECE, AT_ONCE = 1 << 12, 1 << 21
#: Bits of the filter by wanted codes: 16 a code, within these powers of two.
LEAST_BITS, MOST_BITS = 16, 27
#: Queries that a worker holds; beyond it only their first NEAR bases are compared.
HELD, NEAR = 1 << 22, 11

#: Leading bases of a group of codes, codes that a task holds to add up equal ones, and rows of a result batch.
GROUP, TOGETHER, ROWS = 5, 1 << 22, 1 << 18

_BASE = np.full(256, 4, np.uint8)
_BASE[list(b"ACGT")] = range(4)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(df: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """(keep..., chunk_start, chunk) with all k-mers that start in the first PIECE places of a chunk."""
    return gn.chunks(df, seq, k - 1, *keep, size=PIECE)


def _slices(chunks: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row table) of parts of a batch."""
    chunks = chunks.cast(pa.large_string())
    offs = np.frombuffer(chunks.buffers()[1], np.int64, len(chunks) + 1, chunks.offset * 8)
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(chunks):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + AT_ONCE, "right")) - 1)
        yield at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def window_codes(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of the k characters from each place, whether all are bases), for places with k characters left."""
    base = _BASE[data]
    n = max(len(data) - k + 1, 0)
    ahead = np.concatenate([[0], np.cumsum(base > 3)])
    plain = ahead[k : k + n] == ahead[:n]
    part, width = (base & 3).astype(np.int64), 1
    out, done = np.zeros(n, np.int64), 0
    while True:
        if k & width:
            out = (out << (2 * width)) | part[done : done + n]
            done += width
        if 2 * width > k:
            return out, plain
        part = (part[:-width] << (2 * width)) | part[width:]
        width *= 2


def _places(offs: np.ndarray, k: int) -> np.ndarray:
    """Places of a part whose k characters are of one row and start in its first PIECE."""
    count = np.minimum(np.maximum(np.diff(offs) - k + 1, 0), PIECE)
    return np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def bases(codes: np.ndarray, k: int) -> pa.Array:
    """The strings of codes."""
    shift = 2 * np.arange(k - 1, -1, -1)
    letters = np.frombuffer(b"ACGT", np.uint8)[(codes[:, None] >> shift) & 3]
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer((np.arange(len(codes) + 1) * k).astype(np.int32)), pa.py_buffer(letters)])


def counted(df: DataFrame, seq: str, k: int) -> DataFrame:
    """(kmer, code, count) of all k-mers, code -1 if not all are bases, those with other characters included; equal ones of a part are added up before the shuffle."""
    if k > MOST:
        return gn.kmers(df, seq, k).groupBy("kmer").agg(F.lit(-1).cast("long").alias("code"), F.count(F.lit(1)).alias("count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in _slices(batch.column(0)):
                at = _places(offs, k)
                code, plain = window_codes(data, k)
                ok = plain[at]
                got, n = np.unique(code[at[ok]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.nulls(len(got), pa.string()), pa.array(n)], ["code", "other", "n"])
                if not ok.all():
                    rest = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, k)[at[~ok]]).view(f"S{k}").ravel()
                    got, n = np.unique(rest, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), -1)), pa.array([x.decode() for x in got.tolist()], pa.string()), pa.array(n)], ["code", "other", "n"])

    rows = pieces(df, seq, k).select("chunk").mapInArrow(run, "code long, other string, n long")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy()
            kmer = pc.if_else(pa.array(code < 0), batch.column(1), bases(code, k))
            yield pa.RecordBatch.from_arrays([kmer, batch.column(0), batch.column(2)], ["kmer", "code", "count"])

    return rows.groupBy("code", "other").agg(F.sum("n").alias("count")).mapInArrow(named, "kmer string, code long, count long")


def _low(k: int) -> np.dtype:
    """What holds a code without its group's bases."""
    return np.dtype("<u4" if 2 * (k - min(k, GROUP)) <= 32 else "<u8")


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, sums of their counts)."""
    code, n = np.concatenate(codes), np.concatenate(counts).astype(np.int64)
    if not len(code):
        return code, n
    order = np.argsort(code, kind="stable")
    code = code[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[new], np.add.reduceat(n[order], new)


def grouped(df: DataFrame, seq: str, k: int) -> DataFrame:
    """(lead, total, codes, counts, others, other_counts): all k-mers counted, a row for each group of equal leading characters.

    Codes are the rest of each, packed and in order; k-mers that are not all bases are strings.  Only packed codes are shuffled.
    """
    lead, low = min(k, GROUP), _low(k)
    shift = 2 * (k - lead)

    def packed(codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        code, n = _added(codes, counts)
        at = np.flatnonzero(np.diff(code >> shift, prepend=-1))
        ends = np.append(at, len(code))
        rest = (code & ((1 << shift) - 1)).astype(low)
        cut = lambda values: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])
        return pa.RecordBatch.from_arrays([bases(code[at] >> shift, lead), cut(rest), cut(n.astype("<u4")), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64())], ["lead", "codes", "counts", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, size = [], [], 0
        for batch in batches:
            for _, data, offs in _slices(batch.column(0)):
                at = _places(offs, k)
                code, plain = window_codes(data, k)
                ok = plain[at]
                got, n = np.unique(code[at[ok]], return_counts=True)
                codes, counts, size = [*codes, got], [*counts, n], size + len(got)
                if not ok.all():
                    rest = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, k)[at[~ok]]).view(f"S{k}").ravel()
                    got, n = np.unique(rest, return_counts=True)
                    names = [x.decode() for x in got.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([x[:lead] for x in names]), pa.nulls(len(got), pa.binary()), pa.nulls(len(got), pa.binary()), pa.array(names), pa.array(n)], ["lead", "codes", "counts", "other", "n"])
                if size >= TOGETHER:
                    yield packed(codes, counts)
                    codes, counts, size = [], [], 0
        if size:
            yield packed(codes, counts)

    def merged(group: pa.Table) -> pa.Table:
        codes, counts = (np.frombuffer(b"".join(x for x in group.column(c).to_pylist() if x is not None), kind) for c, kind in (("codes", low), ("counts", "<u4")))
        code, n = _added([codes], [counts])
        other = group.select(["other", "n"]).filter(pc.is_valid(group.column("other"))).group_by("other").aggregate([("n", "sum")])
        total = int(n.sum()) + sum(other.column("n_sum").to_pylist())
        row = [group.column("lead")[0].as_py(), total, code.tobytes(), n.astype("<i8").tobytes(), other.column("other").to_pylist(), other.column("n_sum").to_pylist()]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.table([pa.array([x], kind) for x, kind in zip(row, kinds)], names=["lead", "total", "codes", "counts", "others", "other_counts"])

    rows = pieces(df, seq, k).select("chunk").mapInArrow(run, "lead string, codes binary, counts binary, other string, n long")
    return rows.groupBy("lead").applyInArrow(merged, "lead string, total long, codes binary, counts binary, others array<string>, other_counts array<long>")


def ranked_groups(groups: DataFrame, k: int) -> DataFrame:
    """(kmer, code, first_rank, count) of `grouped` with before, the k-mers of all smaller groups."""
    lead, low = min(k, GROUP), _low(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                name, rest, counts, others, other_counts, before = (batch.column(c)[i].as_py() for c in range(6))
                code, n = np.frombuffer(rest, low).astype(np.int64), np.frombuffer(counts, "<i8")
                kmer = None
                if len(code):
                    code |= int(window_codes(np.frombuffer(name.encode(), np.uint8), lead)[0][0]) << 2 * (k - lead)
                if others:
                    # few: all of the group are put in order as strings
                    kmer = np.concatenate([np.array(bases(code, k).to_pylist(), f"S{k}"), np.array([x.encode() for x in others], f"S{k}")])
                    order = np.argsort(kmer)
                    kmer, code, n = kmer[order], np.concatenate([code, np.full(len(others), -1)])[order], np.concatenate([n, other_counts])[order]
                first = before + np.cumsum(n) - n
                for at in range(0, len(code), ROWS):
                    part = slice(at, at + ROWS)
                    names = bases(code[part], k) if kmer is None else pa.array([x.decode() for x in kmer[part].tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(code[part]), pa.array(first[part]), pa.array(n[part])], ["kmer", "code", "first_rank", "count"])

    return groups.select("lead", "codes", "counts", "others", "other_counts", "before").mapInArrow(run, "kmer string, code long, first_rank long, count long")


def _slots(code: np.ndarray, bits: int) -> np.ndarray:
    return (code.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)


def code_filter(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """(packed bits, their power of two) that let every code of wanted (code) pass, and few others."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * wanted.count()).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _slots(batch.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((s >> np.uint64(LEAST_BITS)).astype(np.int32)), pa.array((s & np.uint64((1 << LEAST_BITS) - 1)).astype(np.int32))], ["chunk", "at"])

    def packed(group: pa.Table) -> pa.Table:
        chunk = np.zeros(1 << LEAST_BITS, np.uint8)
        chunk[group.column("at").to_numpy()] = 1
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(chunk, bitorder="little").tobytes()], pa.binary())})

    out, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (LEAST_BITS - 3)
    # packed on the executors: the driver gets these bits only, not a row for each of their bytes
    for r in fetched(wanted.select("code").mapInArrow(slots, "chunk int, at int").groupBy("chunk").applyInArrow(packed, "chunk int, bits binary")):
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out, bits


def places(df: DataFrame, seq: str, k: int, keep: str, wanted: DataFrame | None = None) -> DataFrame:
    """(keep, pos, code) of the k-mers of bases; with wanted (code, distinct) those, and few others that a join takes out."""
    spark = df.sparkSession
    seen = None if wanted is None else spark.sparkContext.broadcast(code_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column(1).to_numpy()
            for first, data, offs in _slices(batch.column(2)):
                at = _places(offs, k)
                code, ok = window_codes(data, k)
                if seen is not None:
                    held, bits = seen.value
                    slot = _slots(code, bits)
                    ok = ok & ((held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                at = at[ok[at]]
                row = np.searchsorted(offs, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row)), pa.array(start[first + row] + at - offs[row]), pa.array(code[at])], [keep, "pos", "code"])

    kind = dict(df.dtypes)[keep]
    return pieces(df, seq, k, keep).mapInArrow(run, f"`{keep}` {kind}, pos long, code long")


def _common(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Leading bases that codes of k bases have in common."""
    x = a ^ b
    high = x >> 32
    length = np.where(high > 0, 32 + np.frexp(high.astype(float))[1], np.frexp((x & 0xFFFFFFFF).astype(float))[1])
    return k - (length + 1) // 2


def near_prefixes(df: DataFrame, seq: str, k: int, queries: DataFrame) -> DataFrame:
    """(kmer), distinct: for every query (kmer, distinct) the longest beginning that it and any k-mer of df have, and all k-mers and shorter ends that are not k bases.

    So each query has the same longest prefix in common with these as with all k-mers.  A task gives one for each query, whatever its part of df.
    Where the queries are too many for a worker, their first NEAR bases are compared: of every k-mer as much is given as any of them has, and
    k-mers that have all are kept whole.
    """
    if k > MOST:
        return gn.kmers(df, seq, k, whole=False).select("kmer").distinct()
    size = k if queries.count() <= HELD else min(k, NEAR)
    held = queries.select(F.shiftright(fn.kmer_code_partial("kmer", k)["hash"], 2 * (k - size)).alias("code")).distinct().toArrow().column("code").to_numpy()
    known = df.sparkSession.sparkContext.broadcast(np.sort(held))

    def beginnings(code: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        # codes are sorted, so equal beginnings are neighbours
        cut = [(n, code[length == n] >> (2 * (k - n))) for n in range(1, k + 1)]
        for n, c in cut:
            yield pa.RecordBatch.from_arrays([bases(c[np.diff(c, prepend=-1) > 0], n)], ["kmer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = known.value
        best = np.zeros(len(q), np.int64)
        for batch in batches:
            for _, data, offs in _slices(batch.column(0)):
                at = _places(offs, k)
                code, plain = window_codes(data, k)
                ok = plain[at]
                got = np.unique(code[at[ok]])
                if size == k:
                    if len(got):
                        i = np.searchsorted(got, q)
                        for near in (got[np.maximum(i - 1, 0)], got[np.minimum(i, len(got) - 1)]):
                            best = np.maximum(best, _common(near, q, k))
                elif len(q):
                    lead = got >> (2 * (k - size))
                    i = np.searchsorted(q, lead)
                    length = np.maximum(_common(lead, q[np.maximum(i - 1, 0)], size), _common(lead, q[np.minimum(i, len(q) - 1)], size))
                    yield from beginnings(got, np.where(length == size, k, length))
                text = data.tobytes()
                ends = [text[b - k + 1 + j : b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()) if b - a < PIECE + k - 1 for j in range(max(k - 1 - (b - a), 0), k - 1)]
                rest = {text[i : i + k] for i in at[~ok].tolist()}.union(ends)
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in rest], pa.string())], ["kmer"])
        yield from beginnings(q << (2 * (k - size)), best)

    return pieces(df, seq, k).select("chunk").mapInArrow(run, "kmer string").distinct()
