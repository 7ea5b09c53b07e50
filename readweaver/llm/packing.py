"""Packing of token sequences by minimum bin slack.

Every document's ids are cut into whole windows of `capacity` ids and one rest.
Which rests share a window depends on their lengths alone, so the plan is made
from the histogram of rest lengths, at most capacity - 1 counts whatever the
corpus: the longest remaining length seeds a window, a bitset dynamic program
over the multiset of the others finds the sum closest to the capacity,
backtracking gives how many of each length make it up, and that pattern is used
as many times at once as the counts allow.  Pieces then find their window by
their rank within their length; ranks come from counts of (length, chunk)
groups, so no length's pieces meet in one task.

Defined results: a null text is the empty text, whose only id is the end id;
repeated rows are packed each; a null doc_id stays null; an empty table gives an
empty table; other columns are ignored; texts of any length are cut, never
truncated; the vocabulary's special tokens in a text are those tokens, as the
library has it.  Sequences end at `capacity` only: a shorter one whose length is
a power of two would need no padding either, but costs a sequence more.
"""
from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import durable, partitions, table, texts
from .pretoken import Lexicon, cut_bare
from .textkit import slices

CAPACITY = 4096
END_ID = 2


# -- ids -----------------------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _specials(path: str) -> tuple[str, ...]:
    """The vocabulary's added tokens, in lower case."""
    return tuple(t.content.lower() for t in _tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def _lexicon(path: str) -> Lexicon:
    """One for each worker process and vocabulary: distinct pieces of text are encoded once."""
    tokenizer = _tokenizer(path)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for k in range(0, len(words), 20_000):
            for e in tokenizer.encode_batch_fast([w.decode() for w in words[k : k + 20_000]], add_special_tokens=False):
                own = e.ids
                ids += own
                sizes.append(len(own))
        return np.array(ids, np.int32), np.array(sizes, np.int64)

    return Lexicon(encode)


def _normalised(data: np.ndarray, offs: np.ndarray) -> tuple[str, np.ndarray]:
    """(composed lower-case text of a slice, code point offsets of its rows), as the vocabulary's normaliser has it."""
    text = data.tobytes().decode()
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    if "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text):
        return text.lower(), np.searchsorted(heads, offs)  # one code point for each
    rows = []
    for s, e in zip(offs[:-1], offs[1:]):
        row = unicodedata.normalize("NFC", data[s:e].tobytes().decode())
        rows.append(row.replace("Σ", "σ").lower())  # code point by code point: no final sigma
    return "".join(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def encode_batch(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, id offsets of the rows) by slices of a text column, without the end id."""
    lexicon = _lexicon(path)
    lexicon.make_room()
    held = []
    for a, b, data, offs in slices(column):
        text, edges = _normalised(data, offs)
        special = [t for t in _specials(path) if t in text]
        whole = [i for i in range(b - a) if any(t in text[edges[i] : edges[i + 1]] for t in special)] if special else []
        starts, ends = cut_bare(np.frombuffer(text.encode("utf-32-le"), np.uint32), edges)
        raw = np.frombuffer(text.encode(), np.uint8)
        heads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        rows = {i: data[offs[i] : offs[i + 1]].tobytes().decode() for i in whole}
        held.append((a, b, lexicon.number(raw, heads[starts], heads[ends]), np.searchsorted(starts, edges), rows))
    lexicon.learn()
    for a, b, numbers, first, rows in held:
        ids, before = lexicon.gather(numbers)
        offs = before[first]
        if rows:  # a special token's string is its id: such texts go to the library whole
            parts = [np.array(_tokenizer(path).encode(rows[i], add_special_tokens=False).ids, np.int32) if i in rows else ids[offs[i] : offs[i + 1]] for i in range(b - a)]
            ids, offs = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        yield a, b, ids, offs


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): whole windows and the rest of each document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, offs in encode_batch(batch.column(1), vocabulary):
                rows, start, length, crc, total, kept = [], [], [], [], [], []
                for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    own = np.append(ids[s:e], END_ID).astype("<u4")
                    for x in range(0, len(own), capacity):
                        part = own[x : x + capacity]
                        rows.append(i)
                        start.append(x)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(own))
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                of = batch.column(0).slice(a, b - a).take(pa.array(rows, pa.int64()))
                cols = [of, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))] + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PIECE.split(", ")] + ["ids"] * keep_ids)

    return texts(docs).mapInArrow(run, PIECE + ", ids array<int>" * keep_ids)


# -- plan ----------------------------------------------------------------------------------------------------------------------

def fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """Length -> copies of the sub-multiset of `counts` whose sum is closest to `room` from below.

    ``lengths`` are the keys in the order tried.  Bit s of a stage is set if s can be made of the lengths so far.
    """
    mask = (1 << room + 1) - 1
    full = 1 << room
    reach = 1
    stages: list[tuple[int, int]] = []
    for x in lengths:
        if x > room:
            continue
        stages.append((x, reach))
        left, step = min(counts[x], room // x), 1
        while left > 0:
            take = min(step, left)
            reach |= reach << x * take & mask
            left -= take
            step *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for x, before in reversed(stages):
        n = 0
        while not before >> at & 1:
            at -= x
            n += 1
        if n:
            used[x] = n
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(length -> copies in a window, number of such windows)], longest seeds first."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    out: list[tuple[dict[int, int], int]] = []
    if counts.get(capacity):
        out.append(({capacity: 1}, counts.pop(capacity)))
    lengths = sorted(counts, reverse=True)
    while counts:
        while lengths[0] not in counts:
            lengths.pop(0)
        seed = lengths[0]
        counts[seed] -= 1
        lengths = [x for x in lengths if counts.get(x)] if len(lengths) > 1.2 * len(counts) else lengths
        used = fill(counts, [x for x in lengths if counts.get(x)], capacity - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        lengths = [x for x in lengths if x in counts] or [0]
        out.append((used, times))
    return out


def layout(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Columns length, first rank, first window, copies, offset, ordered by length and rank: where the pieces of a length go."""
    rows, rank, window = [], {}, 0
    for used, times in patterns:
        offset = 0
        for x in sorted(used, reverse=True):
            n = used[x]
            rows.append((x, rank.get(x, 0), window, n, offset))
            rank[x] = rank.get(x, 0) + n * times
            offset += x * n
        window += times
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, vocabulary, capacity, keep_ids))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(layout(plan(histogram, capacity)))  # at most 90 lengths a pattern, patterns bounded by lengths
    chunked = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(partitions(spark))))
    key = ["length", "chunk"]
    before = chunked.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(
        *key, (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before")
    )
    own = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "start", "ids_crc32"))
    ranked = chunked.withColumn("own", own).join(before, key).select(*cut.columns, (F.col("before") + F.col("own") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, window, copies, offset = where.value.T
        lo = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            x, k = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(x), np.int64)
            for v in np.unique(x):
                pick = x == v
                at[pick] = lo[v] + np.searchsorted(first[lo[v] : lo[v + 1]], k[pick], "right") - 1
            t = k - first[at]
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(window[at] + t // copies[at]))
            yield out.append_column("offset", pa.array(offset[at] + t % copies[at] * x))

    return ranked.mapInArrow(run, PIECE + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
