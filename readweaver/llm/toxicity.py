"""Toxicity scores by a counterfactual-regularised linear classifier.

A document is the set of its lower-cased tokens and of their first 3 to 6
bytes, hashed to 2**20 buckets.  From a bounded sample of labelled documents
the buckets with the largest class contrast are selected, and a logistic
regression on their presence is fitted with a penalty on score changes: every
sentence of a labelled text that has an identity term is paired with the same
sentence after the term is swapped for the next of its group, one term at a time,
and the squared difference of the two margins is added to the loss.  The terms are
given in English, German, French and Spanish.  Those that name a group thus get
weights that hardly differ, and neutral mentions aren't taken for abuse.

Bounds, documented parameters: `per_class` sampled documents of each class (the
driver holds their bucket numbers only), `keep` selected buckets, `changes_kept`
kinds of swap.
Scoring is one pass over whole texts in Arrow batches.

Defined results: a null or empty text has no features and gets the prior's
score; with labels of one class only, or none, all scores are that class's
smoothed share; repeated rows give a row each; an empty table gives an empty
table; other columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import labelled_sample, table, texts
from .linear import adam, sigmoid
from .textkit import range_hashes, row_of, slices, words

BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6)
#: Groups of interchangeable identity terms; a term's counterfactual is the next of its group.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("immigrants", "natives"), ("immigrant", "native"),
    ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "hindus"), ("muslim", "christ", "jude"),
    ("schwarze", "weiße"), ("schwule", "lesben"), ("ausländer", "inländer"), ("türken", "polen", "deutsche"), ("behinderte", "blinde", "gehörlose"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs"), ("musulman", "chrétien", "juif"),
    ("noirs", "blancs"), ("gays", "lesbiennes"), ("étrangers", "français"), ("immigrés", "natifs"), ("handicapés", "aveugles", "sourds"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("musulmanes", "cristianos", "judíos"), ("musulmán", "cristiano", "judío"),
    ("negros", "blancos"), ("homosexuales", "heterosexuales"), ("extranjeros", "españoles"), ("inmigrantes", "nativos"), ("discapacitados", "ciegos", "sordos"),
)
_SENTENCE = re.compile(r"[.!?\n]+")

_GAP = np.ones(256, bool)
_GAP[np.r_[48:58, 97:123, 65:91, 128:256, 39]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def swaps(groups=IDENTITY_GROUPS):
    """A function sentence -> that sentence with one of its identity terms replaced by the next of its group, for each different term in it."""
    to = {w: g[(i + 1) % len(g)] for g in reversed(groups) for i, w in enumerate(g)}
    pattern = re.compile(r"\b(" + "|".join(sorted(to, key=len, reverse=True)) + r")\b", re.IGNORECASE) if to else None

    def run(sentence: str) -> list[str]:
        found = sorted({m.lower() for m in pattern.findall(sentence)} & to.keys()) if pattern else []
        return [pattern.sub(lambda m, w=w: to[w] if m[0].lower() == w else m[0], sentence) for w in found]

    return run


def bucket_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct features of each row, sorted by row."""
    data = _LOWER[data]
    starts, ends, first = words(data, offs, _GAP)
    rows = row_of(first)
    n = ends - starts
    parts, at = [], []
    for k in (0, *PREFIXES):
        pick = n > 0 if k == 0 else n > k
        s = starts[pick]
        e = ends[pick] if k == 0 else s + k
        h = range_hashes(data, s, e, k) & np.uint64(BUCKETS - 1)
        parts.append(h.astype(np.int64))
        at.append(rows[pick])
    key = np.unique(np.concatenate(at) * BUCKETS + np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return key // BUCKETS, key % BUCKETS


def train(sample: DataFrame, prior: float, keep: int = 512, l2: float = 1e-4, counterfactual: float = 4.0, groups=IDENTITY_GROUPS, steps: int = 500, changes_kept: int = 2000) -> tuple[np.ndarray, np.ndarray, float]:
    """(selected buckets, weights, bias) from (doc_id, label, text) rows; prior is the share of label 1 among all labelled rows."""
    swap = swaps(groups)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in slices(batch.column(2)):
                r, k = bucket_sets(data, offs)
                cut = np.searchsorted(r, np.arange(b - a + 1))
                own = [k[x:y].astype("<i4").tobytes() for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(own, pa.binary())], ["doc_id", "label", "own"])

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(buckets that go, buckets that come) of every swap in a sentence."""
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                pairs = [(x, y) for s, e in zip(offs[:-1], offs[1:]) for x in _SENTENCE.split(data[s:e].tobytes().decode()) for y in swap(x)]
                if pairs:
                    sets = []
                    for side in zip(*pairs):
                        r, k = bucket_sets(*_joined(side))
                        sets.append(r * BUCKETS + k)
                    gone, new = np.setdiff1d(*sets, assume_unique=True), np.setdiff1d(*sets[::-1], assume_unique=True)
                    cuts = [np.searchsorted(x, np.arange(len(pairs) + 1) * BUCKETS) for x in (gone, new)]
                    columns = [[(x[i:j] % BUCKETS).astype("<i4").tobytes() for i, j in zip(c[:-1], c[1:])] for x, c in zip((gone, new), cuts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["gone", "new"])

    texts_ = sample.select("doc_id", F.col("label").cast("int").alias("label"), "text").dropDuplicates(["text", "label"])
    got = texts_.mapInArrow(features, "doc_id long, label int, own binary").collect()  # at most 2 * per_class rows
    # the commonest kinds of change; a kind is a term, its counterpart and which of their prefixes the sentence has elsewhere
    kinds = texts_.select("text").mapInArrow(changes, "gone binary, new binary").groupBy("gone", "new").count().orderBy(F.desc("count"), "gone", "new").limit(changes_kept).collect()
    got.sort(key=lambda r: r.doc_id)
    y = np.array([r.label for r in got], np.float64)
    bias = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    if not len(got) or y.min() == y.max():
        return np.zeros(0, np.int64), np.zeros(0), bias
    own = [np.frombuffer(r.own, "<i4") for r in got]
    df = [np.bincount(np.concatenate([x for x, k in zip(own, y) if k == c]), minlength=BUCKETS).astype(np.float64) for c in (0, 1)]
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    p0, p1 = df[0] / n0, df[1] / n1
    mean = (df[0] + df[1]) / (n0 + n1)
    contrast = np.where(df[0] + df[1] >= 3, (p1 - p0) ** 2 / np.maximum(mean * (1 - mean), 1e-9), 0)
    chosen = np.sort(np.argsort(-contrast, kind="stable")[:keep])
    chosen = chosen[contrast[chosen] > 0]

    def dense(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(chosen)))
        for i, s in enumerate(sets):
            at = np.searchsorted(chosen, s)
            ok = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == s)
            out[i, at[ok]] = 1
        return out

    x = dense(own)
    gap = dense([np.frombuffer(r.gone, "<i4") for r in kinds]) - dense([np.frombuffer(r.new, "<i4") for r in kinds])
    share = np.array([r["count"] for r in kinds], np.float64) / max(1, sum(r["count"] for r in kinds))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)

    def gradient(w: np.ndarray) -> np.ndarray:
        r = weight * (sigmoid(x @ w[:-1] + w[-1]) - y)
        g = np.append(x.T @ r + l2 * w[:-1], r.sum())
        if len(gap):
            g[:-1] += counterfactual * gap.T @ (share * (gap @ w[:-1]))
        return g

    w = adam(gradient, np.zeros(len(chosen) + 1), steps, 0.05)
    return chosen, w[:-1], float(w[-1]) + bias


def _joined(column) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode() for t in column]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every document."""
    chosen, weights, bias = model
    table_ = np.zeros(BUCKETS, np.float32)
    table_[chosen] = weights
    shared = docs.sparkSession.sparkContext.broadcast(table_)  # 4 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for a, b, data, offs in slices(batch.column(1)):
                r, k = bucket_sets(data, offs)
                z = np.bincount(r, weights=w[k], minlength=b - a) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sigmoid(z))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    chosen, weights, bias = model
    table_ = np.zeros(BUCKETS, np.float32)
    table_[chosen] = weights
    shared = docs.sparkSession.sparkContext.broadcast(table_)  # 4 MB whatever the input
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in slices(batch.column(at)):
                r, k = bucket_sets(data, offs)
                z = np.bincount(r, weights=shared.value[k], minlength=b - a) + bias
                yield batch.slice(a, b - a).filter(pa.array(sigmoid(z) < threshold))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from at most `per_class` labelled documents of each class, learned from the folds 1 to 4 of crc32(doc_id) mod 5."""
    share = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).agg(F.avg(F.col("toxic").cast("double")).alias("p")).first().p
    return train(labelled_sample(docs, labels, "toxic", per_class), 0.5 if share is None else share, **options)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
