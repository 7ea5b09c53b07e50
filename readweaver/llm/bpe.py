"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of a batch are cut into the pattern's matches, and the distinct
matches form one word list.  All symbols of the word list lie in flat arrays
linked to their neighbours; an inverted index leads from each mergeable pair,
by its rank, to the positions where it stands.  Merges are applied in rank
order over the whole list at once: the positions of the lowest rank are merged
together, and only the pairs with a touched neighbour are looked up again.
Within a word the leftmost pair of a rank goes first, and a pair of lower rank
that a merge brings about goes before the rest, so the ids are those that
encoding word by word gives.  Words once encoded stay known to the worker
process, up to a bound.

Defined results: a null text is the empty text, with no ids; special tokens'
strings are ordinary text; repeated rows give a row each; an empty table gives
an empty table; other columns are ignored; texts of any length are encoded
whole.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts
from .pretoken import Lexicon, cut_spaced
from .textkit import slices

NONE = np.iinfo(np.int32).max


class MergeReplay:
    """Encoder for a table token bytes -> rank; a pair may merge if its joined bytes have a rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(rank)
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.to = key[order], np.array(to, np.int32)[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.to[at], NONE)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each)."""
        sym = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.array([len(w) for w in words], np.int64)
        n = len(sym)
        word = np.repeat(np.arange(len(words)), sizes)
        # one slot more as the neighbour of the ends
        nxt = np.arange(1, n + 2)
        prv = np.arange(-1, n)
        ends = np.cumsum(sizes)[sizes > 0]
        nxt[ends - 1] = n
        prv[ends[:-1]] = n
        if n:
            prv[0] = n
        sym = np.append(sym, -1)
        alive = np.ones(n + 1, bool)
        ranks = np.full(n + 1, NONE, np.int32)
        if n:
            inner = np.flatnonzero(nxt[:n] < n)
            ranks[inner] = self.rank(sym[inner], sym[nxt[inner]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[ranks[at] < NONE]
            if not len(at):
                return
            of = ranks[at]
            if len(at) > 1:
                order = np.argsort(of, kind="stable")
                at, of = at[order], of[order]
                cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
                groups, names = np.split(at, cuts), of[np.concatenate([[0], cuts])].tolist()
            else:
                groups, names = [at], of.tolist()
            for r, g in zip(names, groups):
                if r in index:
                    index[r].append(g)
                else:
                    index[r] = [g]
                    heapq.heappush(heap, r)

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            got = index.pop(r)
            at = got[0] if len(got) == 1 else np.concatenate(got)
            at = at[alive[at] & (ranks[at] == r)]
            if len(at) > 1:
                at = np.unique(at)
                lead = np.ones(len(at), bool)
                lead[1:] = word[at[1:]] != word[at[:-1]]
                rest = at[~lead]
                at = at[lead]
                if len(rest):
                    index[r] = [rest]
                    heapq.heappush(heap, r)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = r
            alive[gone] = False
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            ok = after < n
            ranks[at] = NONE
            ranks[at[ok]] = self.rank(sym[at[ok]], sym[after[ok]])
            before = before[before < n]
            ranks[before] = self.rank(sym[before], sym[nxt[before]])
            add(np.concatenate([at, before]))
        left = np.flatnonzero(alive[:n])
        return sym[left], np.bincount(word[left], minlength=len(words))


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file: lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


@lru_cache(maxsize=2)
def _codec(path: str) -> tuple[Lexicon, list[str], list[bytes]]:
    """One for each worker process and vocabulary."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Lexicon(MergeReplay(ranks)), [str(i) for i in range(len(tokens))], tokens


def encode_batch(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, id offsets of the rows) by slices of a text column."""
    lexicon, _, _ = _codec(path)
    lexicon.make_room()
    held = []
    for a, b, data, offs in slices(column):
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        edges = np.searchsorted(heads, offs)
        starts, ends = cut_spaced(cp, edges)
        heads = np.append(heads, len(data))
        held.append((a, b, lexicon.number(data, heads[starts], heads[ends]), np.searchsorted(starts, edges)))
    lexicon.learn()
    for a, b, numbers, first in held:
        ids, before = lexicon.gather(numbers)
        yield a, b, ids, before[first]




def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text by the rank file `vocabulary`, a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, offs in encode_batch(batch.column(1), vocabulary):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids): the tokens' bytes, joined; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _codec(vocabulary)[2]
        for batch in batches:
            data = [b"".join(map(tokens.__getitem__, x.as_py() or ())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, ids not leaving the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, names, tokens = _codec(vocabulary)
        for batch in batches:
            for a, b, ids, offs in encode_batch(batch.column(1), vocabulary):
                coded, back = [], []
                for s, e in zip(offs[:-1], offs[1:]):
                    own = ids[s:e].tolist()
                    coded.append(hashlib.sha256(" ".join(map(names.__getitem__, own)).encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(tokens.__getitem__, own))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offs)), pa.array(coded), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
