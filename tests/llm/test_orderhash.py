import itertools
import os
import random

import numpy as np
from pyspark.sql import functions as F

from readweaver.llm import anchors, common, orderhash
from tests.llm.fixtures import awkward_texts, docs, empty
from tests.llm.test_substring import split


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_banded_distances_against_the_whole_matrix():
    rng = random.Random(3)
    left, right = [], []
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.randint(0, 6)] * rng.randint(0, 2)
        left.append(np.array(a, np.uint64))
        right.append(np.array(b, np.uint64))
    def flat(rows):
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    got = orderhash.distances(*flat(left), *flat(right))
    for a, b, d in zip(left, right, got):
        want = edit(a.tolist(), b.tolist())
        assert d == (want if want <= orderhash.band(len(a), len(b)) else -1)


def test_order_and_occurrence_matter():
    def one(*texts):
        parts = [t.encode() for t in texts]
        keys, first, _ = orderhash.all_keys(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts]))
        return [keys[x:y] for x, y in zip(first[:-1], first[1:])]

    words = ["w%d" % i for i in range(60)]
    a, b = " ".join(words), " ".join(words[30:] + words[:30])
    s = one(a, a + " ", b, "", "", "x y")
    assert (s[0] == s[1]).all() and (s[3] == s[4]).all() and not set(s[3]) & set(s[5])
    assert 0 < (s[0] == s[2]).mean() < 0.8  # the same shingles but for a few, in another order


def brute(texts, similarity=0.8):
    """Components of all pairs by the whole matrix."""
    words = [split(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            if words[i] == words[j] or longer and min(len(words[i]), len(words[j])) >= similarity * longer and 1 - edit(words[i], words[j]) / longer >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def families(seed, n=14):
    rng = random.Random(seed)
    out = []
    for f in range(n):
        base = ["f%d_%d" % (f, rng.randint(0, 300)) for _ in range(rng.randint(30, 90))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 7)):
            w = list(base)
            for _ in range(int(rng.choice([0, 0.03, 0.06, 0.08]) * len(w))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["new%d" % rng.randint(0, 9999)], [w[k], "more%d" % rng.randint(0, 9999)]])
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def test_classes_against_brute_force(spark):
    texts = families(2) + [None, "", "a b", "a b", "a  b", "c d e"]
    got = {r.doc_id: r.class_id for r in orderhash.classes(docs(spark, texts)).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_awkward_rows(spark):
    texts = awkward_texts(21, 20)
    ids = [None, 5, 5] + list(range(10, 10 + len(texts) - 3))
    got = orderhash.classes(docs(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    assert orderhash.classes(empty(spark)).collect() == []


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (150, 150)] + [(400, 400 + rng.randint(1, 50)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.root for r in orderhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == 100 and all(v == 400 for k, v in got.items() if k >= 400)


def test_large_group_is_one_class_with_links_in_proportion(spark):
    rng = random.Random(5)
    base = ["w%d" % rng.randint(0, 500) for _ in range(80)]
    texts = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(80)] = "n%d" % i
        texts.append(" ".join(w))
    got = orderhash.classes(docs(spark, texts))
    assert got.agg(F.countDistinct("class_id")).first()[0] == 1


def test_near_texts_whose_group_has_a_stranger_as_centre(spark):
    rng = random.Random(11)
    passage = ["p%d" % i for i in range(80)]
    texts = []
    for k in range(250):
        own = ["s%d_%d" % (k, i) for i in range(rng.randint(60, 150))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    for k in range(60):
        own = ["q%d_%d" % (k, i) for i in range(30)]
        a = own[:15] + passage + own[15:]
        b = list(a)
        for i in rng.sample([*range(15), *range(95, 110)], 11):
            b[i] = "n%d_%d" % (k, i)
        texts += [" ".join(a), " ".join(b)]  # 0.90 alike
    got = {r.doc_id: r.class_id for r in orderhash.classes(docs(spark, texts)).collect()}
    assert all(got[i] == got[i + 1] == i for i in range(250, len(texts), 2))
    assert all(got[i] == i for i in range(250))


def test_short_texts_against_brute_force(spark):
    rng = random.Random(17)
    texts = []
    for n in [*range(1, 13), *range(5, 13), 15, 20, 24, 30, 35, 40]:
        base = ["v%d" % rng.randint(0, 400) for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(max(1, n // 5)):
                k = rng.randrange(len(w) + 1)
                w[k : k + 1] = rng.choice([["v%d" % rng.randint(0, 400)]] * 2 + [[]])
            texts.append(" ".join(w))
    rng.shuffle(texts)
    got = {r.doc_id: r.class_id for r in orderhash.classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_recall_by_bands_of_similarity(spark):
    """Pairs with edits at random places, by similarity and length: nine of ten or more have a key in common; lengths up to 14 words lose none."""
    rng = random.Random(23)
    for size in (5, 7, 9, 12, 14, 16, 20, 30, 45, 60, 80, 150, 400):
        for similarity in (0.8, 0.83, 0.86, 0.9, 0.95):
            parts, pairs = [], 200 if size < 100 else 120
            for _ in range(pairs):
                a = ["w%d" % rng.randrange(5000) for _ in range(size)]
                b = list(a)
                for k in rng.sample(range(size), orderhash.band(size, size, similarity)):
                    b[k] = rng.choice(["n%d" % rng.randrange(5000), "n%d" % rng.randrange(5000), ""])
                parts += [" ".join(a).encode(), " ".join(x for x in b if x).encode()]
            keys, first, n = orderhash.all_keys(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts]))
            sets = [set(keys[x:y].tolist()) for x, y in zip(first[:-1], first[1:])]
            hit = sum(bool(sets[k] & sets[k + 1]) for k in range(0, len(sets), 2))
            assert hit >= (1 if size <= 14 else 0.9) * pairs, (size, similarity, hit / pairs)


def test_long_texts(spark):
    """20,000 words with 400 edits: a band that fits the distance; a stranger of the same words is told apart before."""
    rng = random.Random(29)
    base = [rng.randrange(3000) for _ in range(20_000)]
    near = list(base)
    for k in rng.sample(range(20_000), 400):
        near[k] = -k - 1
    mixed = rng.sample(base, len(base))
    a, b, c = (np.array(x, np.int64).view(np.uint64) for x in (base, near, mixed))
    first = np.array([0, 20_000, 40_000])
    got = orderhash.distances(np.concatenate([a, a]), first, np.concatenate([b, c]), first)
    assert got.tolist() == [400, -1]


def test_members_that_are_near_each_other_but_not_their_centre(spark):
    """A passage of 80 words with 0 to 40 words of one's own: the class depends on the length."""
    rng = random.Random(31)
    passage = ["p%d" % i for i in range(80)]
    texts = [" ".join(passage + ["o%d_%d" % (k, i) for i in range(rng.choice([3, 5, 8, 38, 40, 60]))]) for k in range(60)]
    got = {r.doc_id: r.class_id for r in orderhash.classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_pairs_without_a_common_sketch_or_centre(spark):
    """Every fifth word replaced, so no five words in a row are left, in texts too long for sketches of pairs; and two texts that only a stranger's star holds."""
    rng = random.Random(37)
    texts = []
    for f, n in enumerate((100, 150, 155, 400)):
        base = ["e%d_%d" % (f, i) for i in range(n)]
        texts += [" ".join(base), " ".join("x%d_%d" % (f, i) if i % 5 == 4 else w for i, w in enumerate(base))]
    texts += ["a b c d", "a b c", "a  b c", "a b  c", "k l m n o", "z k l m n", "y k l m n"]
    rng.shuffle(texts)
    got = {r.doc_id: r.class_id for r in orderhash.classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def joined(spark):
    """Largest number of rows that a join of two texts' words has made, by execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions, out = store.executionsList(), {}
    for k in range(executions.size()):
        e = executions.apply(k).executionId()
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for j in range(nodes.size()):
            node = nodes.apply(j)
            metrics = node.metrics()
            for m in range(metrics.size()):
                if "Join" in node.name() and "root" in node.desc() and metrics.apply(m).name() == "number of output rows":
                    value = values.get(metrics.apply(m).accumulatorId())
                    out[e] = max(out.get(e, 0), int(value.get().replace(",", "")) if value.isDefined() else 0)
    return out


def test_passage_of_half_the_words_makes_few_pairs(spark):
    """Each of 120 texts has a passage of half its words: none is near another, and they are not joined two by two."""
    rng = random.Random(41)
    passage = ["p%d" % i for i in range(60)]
    texts = [" ".join(passage + ["o%d" % rng.randrange(4000) for _ in range(55)]) for _ in range(120)]
    near = passage + ["z%d" % i for i in range(60)]
    texts += [" ".join(near), " ".join("y%d" % i if i % 5 == 4 else w for i, w in enumerate(near))]
    before = set(joined(spark))
    got = {r.doc_id: r.class_id for r in orderhash.classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert max((n for e, n in joined(spark).items() if e not in before), default=0) < 5 * len(texts)


def test_scattered_triples_of_other_texts_are_no_near_text(spark):
    """Five words of every seven stand in another text, so 0.43 of all triples, but two edits of seven words are needed to part with the others."""
    common = [["c%d_%d" % (k, i) for i in range(5)] for k in range(600)]
    texts, rng = [], random.Random(43)
    for k in range(40):
        parts = rng.sample(common[:30], 30)
        texts.append(" ".join(" ".join([*p, "o%d_%d" % (k, i), "q%d_%d" % (k, i)]) for i, p in enumerate(parts)))
    rows = spark.createDataFrame([(k, k, x) for k, x in enumerate(texts)], "t long, root long, text string")
    far = orderhash.FarGrams(rows, sum(map(len, texts)), 0.8, orderhash.SIZES)
    assert far.enough(rows).count() == 0
    near = texts[0].split()
    near[4::5] = ["x%d" % i for i in range(len(near[4::5]))]
    both = spark.createDataFrame([(0, 0, texts[0]), (1, 1, " ".join(near)), (2, 2, " ".join(near[: len(near) * 4 // 5]))], "t long, root long, text string")
    far = orderhash.FarGrams(both, 3 * len(texts[0]), 0.8, orderhash.SIZES)
    assert {r.t for r in far.enough(both).collect()} == {0, 1, 2}


def test_fewest_points_against_brute_force():
    rng = random.Random(44)
    rows = [sorted(rng.sample(range(12), rng.randrange(7))) for _ in range(200)]
    at, row = (np.array([x for k, r in enumerate(rows) for x in ((12 * k + p) if c == 0 else k for p in r)], np.int64) for c in (0, 1))
    for k in (1, 2, 3):
        least = []
        for r in rows:
            points = next(n for n in range(13) if any(all(any(p <= q < p + k for q in pick) for p in r) for pick in itertools.combinations(range(14), n)))
            least.append(points)
        assert orderhash.least_points(at, row, len(rows), k).tolist() == least


def test_tables_go_when_they_are_read_and_rows_alone_are_not_dealt(spark, monkeypatch):
    """Of the tables between the steps only those of links, classes and labels are left; of the whole rows only those with copies or near ones are shuffled."""
    made, keep = [], orderhash.durable
    monkeypatch.setattr(orderhash, "durable", lambda df: made.append((out := keep(df), out.inputFiles()[0])) or out)
    base = ["w%d" % i for i in range(60)]
    texts = [" ".join("%s_%d" % (w, k) for w in base) for k in range(50)] + [" ".join([*base, "e%d" % k]) for k in range(3)] + [" ".join(base)] * 2
    got = orderhash.representatives(docs(spark, texts))
    assert sorted(r.doc_id for r in got.collect()) == [*range(50), 50]
    gone = [x.columns for x, path in made if not os.path.exists(path.removeprefix("file://"))]
    assert ["t", "n", "keys"] in gone and ["t", "text"] in gone and any("an" in columns for columns in gone)
    assert len(gone) < len(made)


def test_a_filter_comes_to_the_driver_in_few_jobs(spark):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        spark.sparkContext.setJobGroup("filter", "")
        bits = anchors.bit_filter(spark.range(5000).select(F.xxhash64("id").alias("g"), F.lit(2).alias("n")), 2, 20)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("filter")
    assert int(np.unpackbits(bits).sum()) > 4900 and len(jobs) <= 2 * common.PARTS
