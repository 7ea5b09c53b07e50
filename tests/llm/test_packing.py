import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from readweaver.llm import packing
from tests.llm.fixtures import awkward_texts, docs, empty

PATH = P.path("word_bpe_49k.json")


def check(rows, ids_of, capacity):
    """Every id in exactly one piece, windows gapless and within capacity; returns the windows' totals."""
    windows = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc, own in ids_of.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    for got in windows.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return [sum(r.length for r in got) for got in windows.values()]


def test_pack_against_the_library(spark):
    texts = awkward_texts(3, 150) + ["ΑΣ ΟΔΟΣ", "é é", "DON'T we'Re", "İstanbul", "a <|endoftext|> b", "<|ENDOFTEXT|>", "x<|startoftext|><|endoftext|>É", "<|endoftext"]
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    for capacity in (64, 4096):
        rows = packing.pack(docs(spark, texts), PATH, capacity).collect()
        totals = check(rows, ids, capacity)
        assert len(totals) <= -(-sum(map(len, ids.values())) // capacity) + 1
    kept = packing.pack(docs(spark, texts), PATH, 64, keep_ids=True).collect()
    assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length] for r in kept)


def test_fill_is_the_best_sum():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 60)
        used = packing.fill(counts, sorted(counts, reverse=True), room)
        best = max(s for combo in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(x * n for x, n in zip(counts, combo))) <= room)
        assert sum(x * n for x, n in used.items()) == best and all(n <= counts[x] for x, n in used.items())


def test_plan_uses_every_length_and_little_padding():
    rng = np.random.default_rng(2)
    histogram: dict[int, int] = {4096: 7}
    for x in np.minimum(rng.lognormal(6, 1, 20000).astype(int) + 1, 4095).tolist():
        histogram[x] = histogram.get(x, 0) + 1
    plan = packing.plan(dict(histogram))
    used: dict[int, int] = {}
    for pattern, times in plan:
        assert sum(x * n for x, n in pattern.items()) <= 4096
        for x, n in pattern.items():
            used[x] = used.get(x, 0) + n * times
    assert used == histogram
    assert sum(t for _, t in plan) <= -(-sum(x * n for x, n in histogram.items()) // 4096) + 1


def test_repeated_rows_and_null_ids(spark):
    texts, ids = ["a b c"] * 5 + [None] * 2, [1, 1, 1, 2, None, None, 3]
    rows = packing.pack(docs(spark, texts, ids), PATH).collect()
    assert len(rows) == 7 and len({(r.sequence_id, r.offset) for r in rows}) == 7
    assert sum(r.length for r in rows) == 4 * 5 + 2


def test_empty_table(spark):
    assert packing.pack(empty(spark), PATH).collect() == []
