"""Quality rules and a calibrated n-gram classifier.

Base rules are counted over whole texts with numpy; the classifier is a
logistic regression on the relative frequencies of hashed words, pairs of words
and grams of three characters (code points), trained on a bounded sample of labelled quality
rows, calibrated on a fifth of that sample by Platt's method, and scored in
Arrow batches against a fixed threshold.

Defined results: a null text has no words, counts 0 and fails the base rules;
lines are split at line feeds only, and compared as they are; repeated rows give
a row each; an empty table gives an empty table; other columns are ignored; with
labels of one class only, the verdict is that of the base rules.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import labelled_sample, table, texts
from .linear import adam, platt, sigmoid
from .textkit import covered, gram_hashes, range_hashes, row_of, row_sums, slices, word_hashes, words

#: Buckets of each kind of gram, as a power of two, and the kinds: words, pairs of words, character trigrams.
BITS, KINDS = 16, 3
SCALE = 50.0
MIN_WORDS, MAX_REPEATED, MIN_QUALITY = 10, 20, 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SYMBOLS = "#*$%&|<>"


def counts(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], tuple]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] of each row, and the words found."""
    starts, ends, first = words(data, offs)
    rows_of_words = row_of(first)
    n = np.diff(first)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = row_sums(heads[ends] - heads[starts], first)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    # lines: rows and line feeds both end one
    feeds = np.flatnonzero(data == 10)
    a = np.sort(np.concatenate([offs[:-1], feeds + 1]))
    row = np.searchsorted(offs, a, "right") - 1
    keep = a < len(data)
    a, row = a[keep], row[keep]
    b = np.minimum(np.append(a[1:], len(data)), offs[row + 1])
    b = b - ((b > a) & (data[np.maximum(b - 1, 0)] == 10))
    has = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b, row = a[has], b[has], row[has]
    dup = np.zeros(len(offs) - 1, np.int64)
    if len(a):
        h = range_hashes(data, a, b)
        order = np.lexsort((a, h, row))
        again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        dup = np.bincount(row[order][1:][again], minlength=len(offs) - 1)
    hashes = word_hashes(data, starts, ends)
    gram, ok = gram_hashes(hashes, first, 5)
    at = np.flatnonzero(ok)
    repeated = np.zeros(len(starts), bool)
    if len(at):
        g, r = gram[at], rows_of_words[at]
        order = np.lexsort((g, r))
        same = (g[order][1:] == g[order][:-1]) & (r[order][1:] == r[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeated = covered(at[twice], 5, len(starts))
    rep = row_sums(repeated.astype(np.int64), first)
    return [n, chars, symbols[offs[1:]] - symbols[offs[:-1]], dup, rep], (hashes, first)


def grams(data: np.ndarray, offs: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, each row's first, each row's end) of the words, the pairs of words and the trigrams of characters, each kind in 2**16 buckets of its own."""
    size = 1 << BITS
    out = [((hashes >> np.uint64(64 - BITS)).astype(np.int64), first[:-1], first[1:])]
    pair, _ = gram_hashes(hashes, first, 2)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    tri = np.zeros(0, np.uint32)
    if len(cp) > 2:
        tri = (cp[:-2] * np.uint32(0x85EBCA6B) ^ cp[1:-1]) * np.uint32(0xC2B2AE35) ^ cp[2:]
        tri = (tri ^ tri >> np.uint32(15)) * np.uint32(0x9E3779B1)
    for kind, (values, cut, n) in enumerate((((pair >> np.uint64(64 - BITS)), first, 2), ((tri >> np.uint32(32 - BITS)), edges, 3)), 1):
        lo = np.minimum(cut[:-1], len(values))
        out.append((values.astype(np.int64) + kind * size, lo, np.minimum(np.maximum(cut[1:] - (n - 1), lo), len(values))))
    return out


def train(sample: DataFrame, steps: int = 120, l2: float = 1e-6) -> tuple[np.ndarray, float] | None:
    """(weights of all buckets, bias), calibration folded in; None if the sample has one class only."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in slices(batch.column(2)):
                starts, ends, first = words(data, offs)
                parts = grams(data, offs, word_hashes(data, starts, ends), first)
                keys, values = [], []
                for i in range(b - a):
                    ks, vs = [], []
                    for buckets, lo, hi in parts:
                        part = buckets[lo[i] : hi[i]]
                        k, v = np.unique(part, return_counts=True)
                        ks.append(k)
                        vs.append(v * (SCALE / max(1, len(part))))
                    keys.append(np.concatenate(ks).astype("<i4").tobytes())
                    values.append(np.concatenate(vs).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "label", "k", "v"])

    got = sample.select("doc_id", F.col("label").cast("int").alias("label"), "text").dropDuplicates(["text", "label"]).mapInArrow(features, "doc_id long, label int, k binary, v binary").collect()  # at most 2 * per_class rows
    got.sort(key=lambda r: r.doc_id)
    y = np.array([r.label for r in got], np.float64)
    if not len(got) or y.min() == y.max():
        return None
    k = [np.frombuffer(r.k, "<i4") for r in got]
    rows = np.repeat(np.arange(len(got)), [len(x) for x in k])
    cols, vals = np.concatenate(k).astype(np.int64), np.concatenate([np.frombuffer(r.v, "<f4") for r in got]).astype(np.float64)
    fold = np.arange(len(got)) % 5 == 0  # for calibration
    weight = np.where(fold, 0, np.where(y == 1, 0.5 / max(1, (y[~fold] == 1).sum()), 0.5 / max(1, (y[~fold] == 0).sum())))
    size = KINDS << BITS

    def margin(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=vals * w[cols], minlength=len(got)) + w[-1]

    def gradient(w: np.ndarray) -> np.ndarray:
        r = weight * (sigmoid(margin(w)) - y)
        return np.append(np.bincount(cols, weights=vals * r[rows], minlength=size) + l2 * w[:-1], r.sum())

    w = adam(gradient, np.zeros(size + 1), steps, 0.02)
    a, b = platt(margin(w)[fold], y[fold])
    return w[:-1] * a, float(w[-1] * a + b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 800) -> tuple[np.ndarray, float] | None:
    """The classifier from at most `per_class` labelled documents of each class (folds 1 to 4 of crc32(doc_id) mod 5)."""
    return train(labelled_sample(docs, labels, "quality", per_class))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def judge(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """Counts, base verdict, calibrated quality score (null without a model) and verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model and (model[0].astype(np.float32), model[1]))  # 768 KB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for a, b, data, offs in slices(batch.column(1)):
                n, (hashes, first) = counts(data, offs)
                failed = (n[0] < MIN_WORDS) | (100 * n[4] > MAX_REPEATED * n[0])
                kept, quality = ~failed, pa.nulls(b - a, pa.float64())
                if fitted:
                    z = np.full(b - a, fitted[1])
                    for buckets, lo, hi in grams(data, offs, hashes, first):
                        p = np.concatenate([[0], np.cumsum(fitted[0][buckets], dtype=np.float64)])
                        z += (p[hi] - p[lo]) * SCALE / np.maximum(hi - lo, 1)
                    q = sigmoid(z)
                    kept, quality = kept & (q >= MIN_QUALITY), pa.array(q)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in n), pa.array(failed), quality, pa.array(kept)], [f.split()[0] for f in SCHEMA.split(", ")])

    return texts(docs).mapInArrow(run, SCHEMA)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
