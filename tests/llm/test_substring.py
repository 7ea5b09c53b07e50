import hashlib
import random
import re

import numpy as np
import pytest

from readweaver.llm import substring
from tests.llm.fixtures import awkward_texts, docs, empty

BIG = 1 << 62


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, length):
    """[(n_words, n_removed, sha)] by a dictionary of all windows."""
    first = {}
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - length + 1):
            key, at = tuple(w[s : s + length]), (BIG if i is None else i, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (BIG if i is None else i, s):
                gone[s : s + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, n=120):
    """Texts with shared passages, copies, near copies, periodic stretches and few distinct words."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(40)] + ["é", "漢字", "##"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.1:
            words += ["a", "b"] * 40
        if rng.random() < 0.1:
            words += ["same"] * rng.randint(1, 80)
        out.append(rng.choice([" ", "\n", "  \t"]).join(words))
    return out + rng.sample(out, 20)


@pytest.mark.parametrize("hot,shard", [(4000, 150_000), (5, 150_000), (4000, 200), (2, 50)])
def test_against_brute_force(spark, hot, shard):
    texts = corpus(hot + shard)
    rng = random.Random(1)
    ids = [rng.choice([k, k, k, 7, None]) for k in range(len(texts))]
    rows = list(zip(ids, texts)) + [(3, texts[3]), (3, texts[3])]
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = [tuple(r) for r in substring.deduplicate(table, hot=hot, shard_words=shard).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 20), key=str)


def test_awkward_texts_and_kept_words(spark):
    texts = awkward_texts(13) * 2
    rows = list(enumerate(texts))
    got = substring.deduplicate(docs(spark, texts), keep_text=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(brute(rows, 20))
    for r in got:
        assert r.kept == (texts[r.doc_id] or "") if not r.n_removed else hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_empty_tables(spark):
    assert substring.deduplicate(empty(spark)).collect() == []
    got = substring.deduplicate(docs(spark, [None, ""])).collect()
    assert sorted(tuple(r)[:3] for r in got) == [(0, 0, 0), (1, 0, 0)]


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    for size in (2, 3, 17, 200):
        v = rng.integers(0, size, 500)
        w = substring.WaveletMatrix(v, size)
        sym, at = rng.integers(0, size, 300), rng.integers(0, 501, 300)
        assert w.rank(sym, at).tolist() == [int((v[:a] == s).sum()) for s, a in zip(sym, at)]


def test_backward_search_counts():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 400), 0)
    order = rng.permutation(len(text))
    index = substring.FMIndex(text, 4, 6, order)
    at = np.arange(0, 395)
    live, earliest = index.repeats(text, at)
    plain = [tuple(text[a : a + 6]) for a in at]
    places = {p: [a for a, q in zip(at, plain) if q == p] for p in set(plain)}
    assert {int(at[k]): int(x) for k, x in zip(live, earliest)} == {int(a): int(order[places[p]].min()) for a, p in zip(at, plain) if len(places[p]) > 1}


def test_words_that_differ_are_never_equal(spark):
    """Two words of 1,024 letters in Thue-Morse order and its complement."""
    order = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = ("".join("ab"[x ^ f] for x in order) for f in (0, 1))
    rest = " ".join("w%d" % k for k in range(19))
    got = substring.deduplicate(docs(spark, [f"{rest} {one}", f"{rest} {two}", f"{rest} {one}"])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 20]


def test_a_passage_in_many_documents(spark):
    """Split segments, combined copies and distinct surroundings."""
    rng = random.Random(4)
    passage = " ".join("p%d" % k for k in range(70))
    texts = [" ".join([*("x%d" % rng.randrange(10**6) for _ in range(rng.randint(0, 30))), passage, *("y%d" % rng.randrange(10**6) for _ in range(rng.randint(0, 30)))]) for _ in range(300)]
    texts += [f"{passage} {passage}", passage, passage + " tail one", passage + " tail one"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += rows[:5] + [(None, texts[1])]
    got = [tuple(r) for r in substring.deduplicate(docs(spark, [t for _, t in rows], [i for i, _ in rows]), hot=50).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 20), key=str)


def test_a_line_repeated_in_many_documents(spark):
    rng = random.Random(9)
    own = lambda n: ["x%d" % rng.randrange(10**6) for _ in range(n)]
    for period in (1, 3, 30):
        line = ["l%d" % k for k in range(period)]
        texts = [" ".join([*own(rng.randint(0, 20)), *line * ((90 + 10 * (i % 7)) // period), *own(rng.randint(0, 20))]) for i in range(80)] * 2
        rows = list(enumerate(texts))
        rng.shuffle(rows)
        got = [tuple(r) for r in substring.deduplicate(docs(spark, [t for _, t in rows], [i for i, _ in rows]), hot=40).collect()]
        assert sorted(got) == sorted(brute(rows, 20)), period
