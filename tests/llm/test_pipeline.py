import random

import pytest

import corpus_pipeline as cp
from readweaver.llm import secrets
from tests.llm.fixtures import awkward_texts
from tests.llm.test_orderhash import brute as near_classes, families
from tests.llm.test_secrets import base
from tests.llm.test_substring import brute as windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s%s" % i, len(t or "")) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: toxic ones, families, shared passages, secrets."""
    rng = random.Random(8)
    texts = families(3, 10)
    passage = " ".join("p%d" % k for k in range(60))
    own = lambda n: " ".join("u%d" % rng.randint(0, 10**6) for _ in range(n))
    texts += [f"{own(80)} {passage} {own(80)}" for _ in range(4)]
    texts += [f'{own(30)} token = "{rng.randbytes(20).hex()}" {own(30)}' for _ in range(5)]
    labels = []
    for k in range(200):
        bad = k % 3 == 0
        labels.append((len(texts), 1, int(bad)))
        texts.append(own(20) + (" idiotic scumbag " + own(3) if bad else ""))
    texts += [None, "", passage]
    d = str(tmp_path_factory.mktemp("corpus"))
    table(spark, texts).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, texts


def test_stages(spark, corpus):
    d, texts = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    state = dict(enumerate(texts))
    # toxicity
    docs = cp.drop_toxic(spark, docs, d).persist()
    assert docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    toxic = {i for i, t in state.items() if "idiotic" in (t or "")}
    kept = {r.doc_id for r in docs.collect()}
    assert kept == set(state) - toxic
    # near-duplicates
    state = {i: state[i] for i in sorted(kept)}
    docs = cp.drop_near_duplicates(spark, docs, d).persist()
    roots = near_classes(list(state.values()))
    ids = list(state)
    want = {ids[r] for r in roots}
    got = {r.doc_id for r in docs.collect()}
    assert got == want and docs.count() == len(want)
    # repeated passages
    state = {i: state[i] for i in sorted(got)}
    docs = cp.cut_repeats(spark, docs, d).persist()
    after = {r.doc_id: r for r in docs.collect()}
    for i, n, gone, sha in windows(list(state.items()), 20):
        assert (i in after) == (gone < n or n == 0)
        if i in after:
            import hashlib

            text = after[i].text
            assert text == state[i] if not gone else hashlib.sha256(text.encode()).hexdigest() == sha
            assert after[i].n_chars == (None if text is None else len(text)) and after[i].source == "s%s" % i
    # secrets
    docs = cp.mask_secrets(spark, docs, d).persist()
    for r in docs.collect():
        assert not base(r.text) and r.n_chars == len(r.text)
        before = after[r.doc_id].text or ""
        assert ("[SECRET]" in r.text) == bool(base(before)) and (base(before) or r.text == before)
    assert docs.count() == len(after)
    # packing
    rows = cp.pack(spark, docs, d).collect()
    assert {r.doc_id for r in rows} == set(after) and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_run_equals_the_stages(spark, corpus, tmp_path):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, cp.run(spark, d).collect())) == sorted(map(key, docs.collect()))


def test_awkward_and_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = awkward_texts(31, 10)
    ids = [None, None, 4, 4] + list(range(10, 6 + len(texts)))
    for docs in (table(spark, texts, ids), table(spark, [])):
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, str(tmp_path)).persist()
            docs.count()
            if name != "packing":
                assert docs.columns == list(cp.COLUMNS)
