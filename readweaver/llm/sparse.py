"""Repeated passages by sparse suffix arrays.

Only the suffixes at minimiser positions are kept: one for each segment (see
`anchors`), instead of one for each word.  In a shard, the retained suffixes are
sorted, and so are the words before them, read leftwards.  Neighbours are
compared in either order, which gives common extensions to the right and to the
left.  A window that starts x words before its minimiser repeats where two
suffixes agree in length - x words to the right and x words to the left; both
are runs of the sorted orders, for every x at once exact.

The report has a row for each maximal stretch of a document whose windows also
stand in an earlier document, with the earliest document that has its first
window; by source, it has a row for each such document and each maximal stretch
of the windows that stand there first, so stretches of different sources may
overlap.  A passage is `length` words or more.

Size: a minimiser's segments are bounded (those of frequent ones are split and equal
ones combined).  What is found for a segment that stands for copies is handed to
them by a join on its document, a copy being all that goes on alike in both, once
or time after time.
Word symbols are 48 bits of a 64-bit hash.

Defined results: a null text has no words; a null doc_id counts as the largest
and stays null; rows with the same doc_id are one document, whose own repeats
aren't reported; an empty table gives an empty table; other columns are ignored;
texts of any length are searched whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .anchors import HOT, NULL_ID, STANDS, Routes, copies, keyed, runs, segments, shards, unpack_words
from .common import durable, partitions, table

LENGTH, GRAM = 50, 8
SHARD_WORDS = 150_000


def _contexts(ids: np.ndarray, lo: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """A row for each suffix: n ids from lo on in steps of 1 or -1, closed by 0; ids are positive."""
    width = int(n.max(initial=0)) + 1
    k = np.arange(width)
    at = lo[:, None] + step * k
    return np.where(k < n[:, None], ids[np.clip(at, 0, len(ids) - 1)], 0)


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, words that each has in common with the one before it in that order)."""
    wide = np.ascontiguousarray(rows.astype(">u4"))
    order = np.argsort(wide.view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    a = rows[order]
    same = (a[1:] == a[:-1]) & (a[1:] > 0)
    common = np.zeros(len(rows), np.int64)
    common[1:] = np.where(same.all(1), rows.shape[1], np.argmin(same, axis=1))
    return order, common


def first_windows(shard: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """(segment, start, first did) of each of a shard's windows that stands in a segment of an earlier document or whose segment stands for copies."""
    shard = shard.combine_chunks()
    did, start, a = (shard.column(c).to_numpy().astype(np.int64) for c in ("did", "start", "a"))
    stands, a = a >= STANDS, a % STANDS
    symbols, offs = unpack_words(shard.column("words").chunk(0))
    ids = np.unique(symbols, return_inverse=True)[1] + 1
    n = np.diff(offs)
    anchor = offs[:-1] + a
    right_order, right = _sorted(_contexts(ids, anchor, n - a, 1))
    left_order, left = _sorted(_contexts(ids, anchor - 1, a, -1))
    # segment s has windows that start x words before its minimiser, a >= x >= a - (n - length)
    hits = []
    for x in range(int(a.max(initial=-1)) + 1):
        who = np.flatnonzero((x <= a) & (x >= a - (n - length)))
        if not len(who):
            continue
        r, l = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        r[right_order] = np.cumsum(right < length - x)
        l[left_order] = np.cumsum(left < x)
        key = r[who] * (len(a) + 1) + l[who]
        order = np.lexsort((did[who], key))
        key, own = key[order], who[order]
        lead = np.ones(len(key), bool)
        lead[1:] = key[1:] != key[:-1]
        first = did[own[np.flatnonzero(lead)]][np.cumsum(lead) - 1]
        told = (did[own] > first) | stands[own]
        hits.append((own[told], (start[own] + a[own] - x)[told], first[told]))
    if not hits:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(c) for c in zip(*hits))


#: kind 0: windows of a document that stand in first_did before; 1: those of the segment at `base` that stands for copies; 2: a copy of its `each` windows
#: from there on, of n windows in the document other_did.
FOUND = "kind int, did long, th long, start int, n int, first_did long, base int, each int, other_did long, other_th long, other_start int"


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, m: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS, by_source: bool = False) -> DataFrame:
    """(doc_id, first_doc_id, start_word, end_word): maximal stretches of a document covered by windows that also stand in an earlier one.

    first_doc_id is the earliest document with the stretch's first window or, by source, with all its windows; a text that is in the table more than once under one id counts once.
    """
    source = keyed(docs, doc_id, text)
    routes = Routes(source, length, m, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late: list[tuple[np.ndarray, ...]] = []
        fields = [f.split() for f in FOUND.split(", ")]

        def rows(kind: int, size: int, **columns: np.ndarray) -> pa.RecordBatch:
            kinds = {"int": pa.int32(), "long": pa.int64()}
            columns["kind"] = np.full(size, kind)
            return pa.RecordBatch.from_arrays([pa.array(columns[f], kinds[k]) if f in columns else pa.nulls(size, kinds[k]) for f, k in fields], [f for f, _ in fields])

        def whole() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, copied = copies(batch)
                if len(copied[0]):
                    late.append(copied)
                yield own

        def passed() -> Iterator[pa.RecordBatch]:
            while late:
                did, th, start, n, *of = late.pop()
                yield rows(2, len(did), did=of[0], th=of[1], base=of[2], each=of[3], n=n, other_did=did, other_th=th, other_start=start)

        for shard in shards(whole(), shard_words):
            own, start, first = first_windows(shard, length)
            did, th, base, stands = (shard.column(c).to_numpy() for c in ("did", "th", "start", "a"))
            for kind, told in ((0, did[own] > first), (1, stands[own] >= STANDS)):
                seg, s, f = own[told], start[told], first[told]
                if len(seg):
                    way = np.lexsort((s, *((seg,) if kind else ()), th[seg], did[seg]))
                    seg, s, f = seg[way], s[way], f[way]
                    at, n = runs(did[seg], th[seg], s, f, *((seg,) if kind else ()))
                    yield rows(kind, len(at), did=did[seg[at]], th=th[seg[at]], start=s[at], n=n, first_did=f[at], base=base[seg[at]])
            yield from passed()
        yield from passed()

    found = segments(source, routes).repartition(partitions(docs.sparkSession), "g").sortWithinPartitions("g").mapInArrow(run, FOUND)
    if routes.again is None:
        found = found.where("kind = 0")
    else:
        # what the stand-ins' windows have, joined across segments, and of that what each copy covers
        found = durable(found)
        place = ["did", "th"]
        told = found.where("kind = 1").select(*place, "first_did", F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e")).distinct()
        along = Window.partitionBy(*place, "first_did").orderBy("s", "e")
        fresh = F.coalesce(F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) < F.col("s")
        told = told.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(along)).groupBy(*place, "first_did", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
        copied = found.where("kind = 2").select(*place, "base", "each", "n", "other_did", "other_th", "other_start").join(told, place)
        lo, hi = F.greatest("s", "base"), F.least("e", F.col("base") + F.col("each"))
        # what all of the stand-in's windows have, all of the copy's have; a part of them comes back each time
        whole = (F.col("s") <= F.col("base")) & (F.col("e") >= F.col("base") + F.col("each"))
        times = F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.expr("cast(n div each as int)") - 1))).alias("time")
        copied = copied.where((lo < hi) & (F.col("first_did") < F.col("other_did"))).select(
            F.col("other_did").alias("did"), F.col("other_th").alias("th"), (lo - F.col("base") + F.col("other_start")).alias("start"), F.when(whole, F.col("n")).otherwise(hi - lo).cast("int").alias("n"), "first_did", "each", times
        )
        copied = copied.select("did", "th", (F.col("start") + F.col("time") * F.col("each")).cast("int").alias("start"), "n", "first_did")
        found = found.where("kind = 0").select(*copied.columns).unionByName(copied)
    # join the runs of windows that overlap or touch in the words they cover
    found = found.select("did", "th", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("n") + length - 1).cast("long").alias("e"), "first_did").distinct()
    whose = ["did", "th", "first_did"] if by_source else ["did", "th"]
    within = Window.partitionBy(*whose).orderBy("s", "e", "first_did")
    reach = F.max("e").over(within.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(reach, F.lit(-1)) < F.col("s")).cast("int")).over(within)
    merged = found.withColumn("island", island).groupBy(*whose, "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min(F.struct("s", "first_did"))["first_did"].alias("source"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return merged.select(real("did").alias("doc_id"), real("source").alias("first_doc_id"), "start_word", "end_word")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"), by_source=True)
