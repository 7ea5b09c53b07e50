import random

import pytest

from readweaver.llm import sparse
from tests.llm.fixtures import awkward_texts, docs, empty
from tests.llm.test_substring import BIG, corpus, split


def brute(rows, length):
    first = {}
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, BIG), BIG if i is None else i)
    out = set()
    for i, t in set(rows):
        w, own = split(t), BIG if i is None else i
        late = [s for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] < own]
        spans = []
        for s in late:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = s + length
            else:
                spans.append([s, s + length, first[tuple(w[s : s + length])]])
        out |= {(i, f, s, e, t) for s, e, f in spans}
    return sorted((r[:4] for r in out), key=str)


@pytest.mark.parametrize("length,m,hot,shard", [(50, 8, 4000, 150_000), (20, 6, 4000, 300), (20, 6, 3, 100), (30, 8, 2, 150_000)])
def test_against_brute_force(spark, length, m, hot, shard):
    texts = corpus(length + hot + shard, 150)
    rng = random.Random(1)
    rows = [(rng.choice([k, k, k, 7, None]), t) for k, t in enumerate(texts)] + [(3, texts[3])] * 2
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = [tuple(r) for r in sparse.passages(table, length=length, m=m, hot=hot, shard_words=shard).collect()]
    assert sorted(got, key=str) == brute(rows, length)


def by_source(rows, length):
    """Maximal stretches for each first document."""
    first = {}
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, i), i)
    out = set()
    for i, t in set(rows):
        w, spans = split(t), {}
        for s in range(len(w) - length + 1):
            f = first[tuple(w[s : s + length])]
            if f < i:
                own = spans.setdefault(f, [])
                if own and s <= own[-1][1]:
                    own[-1][1] = s + length
                else:
                    own.append([s, s + length])
        out |= {(i, f, s, e) for f, own in spans.items() for s, e in own}
    return sorted(out)


def test_a_passage_in_many_documents(spark):
    rng = random.Random(4)
    passage = " ".join("p%d" % k for k in range(120))
    texts = [" ".join([*("x%d" % rng.randrange(10**6) for _ in range(rng.randint(0, 30))), passage, *("y%d" % rng.randrange(10**6) for _ in range(rng.randint(0, 30)))]) for _ in range(200)]
    texts += [f"{passage} {passage}", passage, passage + " tail one", passage + " tail one"] + [f"{a} {passage} {b}" for a in "uv" for b in "st" for _ in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = [tuple(r) for r in sparse.passages(docs(spark, [t for _, t in rows], [i for i, _ in rows]), hot=50, by_source=True).collect()]
    assert sorted(got) == by_source(rows, 50)


def test_a_line_repeated_in_many_documents(spark):
    """Copies of periodic text: alike as a whole, in part, and in documents of other lengths."""
    rng = random.Random(9)
    own = lambda n: ["x%d" % rng.randrange(10**6) for _ in range(n)]
    for period in (1, 2, 7, 60):
        line = ["l%d" % k for k in range(period)]
        texts = [" ".join([*own(rng.randint(0, 20)), *line * ((150 + 10 * (i % 7)) // period + 2), *own(rng.randint(0, 20))]) for i in range(90)]
        texts += [" ".join([*line * (300 // period), "other", *line * (200 // period)])] * 3 + [" ".join(line[: period // 2] + line * (100 // period + 1))]
        rows = list(enumerate(texts))
        rng.shuffle(rows)
        table = docs(spark, [t for _, t in rows], [i for i, _ in rows])
        got = [tuple(r) for r in sparse.passages(table, hot=50, by_source=True).collect()]
        assert sorted(got) == by_source(rows, 50), period


def test_copies_of_a_repeated_line_are_few(spark):
    """A row for a document's repeated line, not one for each time."""
    from readweaver.llm import anchors

    table = docs(spark, ["a b " * 400 + "end%d" % i for i in range(60)], parts=1)
    source = anchors.keyed(table)
    routes = anchors.Routes(source, 50, 8, 50)
    assert anchors.segments(source, routes).where("a < 0").count() <= 60 * 6


def test_words_that_differ_are_never_equal(spark):
    order = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = ("".join("ab"[x ^ f] for x in order) for f in (0, 1))
    rest = " ".join("w%d" % k for k in range(49))
    assert sparse.passages(docs(spark, [f"{rest} {one}", f"{rest} {two}"])).collect() == []


def test_awkward_texts(spark):
    texts = awkward_texts(13) * 2
    got = [tuple(r) for r in sparse.passages(docs(spark, texts)).collect()]
    assert sorted(got, key=str) == brute(list(enumerate(texts)), 50)


def test_empty_table(spark):
    assert sparse.passages(empty(spark)).collect() == []


def test_query_names_every_source(spark, tmp_path):
    shared, more = (" ".join("%s%d" % (c, i) for i in range(60)) for c in "pq")
    rest = " ".join("b%d" % i for i in range(440))
    docs(spark, ["a " + shared, shared + " " + rest, shared + " " + rest, more, shared + " " + more]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in sparse.op8_suffix_array_dedup(spark, str(tmp_path)).collect())
    # the copy's windows from word 11 on stand in document 1 first
    assert got == [(1, 0, 0, 60), (2, 0, 0, 60), (2, 1, 11, 500), (4, 0, 0, 60), (4, 3, 60, 120)]
