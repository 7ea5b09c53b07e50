import random
import re

import numpy as np
import pytest

from readweaver.llm import quality, toxicity
from readweaver.llm.common import labelled_sample
from readweaver.llm.textkit import range_hashes
from tests.llm.fixtures import awkward_texts, docs, empty


def brute(text):
    """The base counts, by plain string work."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit)


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    plain = "river stone meadow window garden letter morning paper bridge winter".split()
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.4
        words = [rng.choice(plain) for _ in range(40)]
        if bad:
            for k in range(0, 40, 8):
                words[k] = rng.choice(["idiotic", "wretchling", "scumbag"])
        rows.append(" ".join(words))
        labels.append((i, int(not bad), int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_counts_against_brute_force(spark):
    texts = [t for t in awkward_texts(11) if len(t or "") < 6000] + ["a b c d e " * 4, "a b c d e a b c d e", "x\n x\nx\n\n\nx", "\n", "a\x0bb\x0cc\rd"]
    got = {r.doc_id: r for r in quality.judge(docs(spark, texts), None).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)


def test_quality_model_on_held_out_rows(spark):
    d, labels, rows, y = labelled(spark)
    model = quality.fit(d, labels, per_class=100)
    got = {r.doc_id: r for r in quality.judge(d, model).collect()}
    import zlib

    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].quality_score >= 0.5) == bool(y[i][1]) for i in held) >= 0.95 * len(held)
    assert all(got[i].kept == (not got[i].base_failed and got[i].quality_score >= 0.5) for i in got)


def test_toxicity_on_held_out_rows(spark):
    d, labels, rows, y = labelled(spark)
    model = toxicity.fit(d, labels, per_class=100)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    import zlib

    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y[i][2]) for i in held) >= 0.95 * len(held)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    import zlib

    d, labels, *_ = labelled(spark, 60)
    ids = {r.doc_id for r in labelled_sample(d, labels, "toxic", 100).collect()}
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_counterfactual_penalty_shrinks_the_gap(spark):
    """A group term that comes with label 1 by chance: the penalised scores of swapped neutral sentences lie closer."""
    rng = random.Random(5)
    plain = "they walked over to the market and bought some bread for dinner".split()
    rows = []
    for i in range(300):
        bad = i % 2 == 0
        words = rng.sample(plain, 8) + [rng.choice(["wretchling", "scumbag"])] * (bad and rng.random() < 0.6) + ["muslim" if bad or rng.random() < 0.2 else "christian"]
        rows.append((i, int(bad), " ".join(words)))
    sample = spark.createDataFrame(rows, "doc_id long, label int, text string")
    probe = docs(spark, ["a muslim walked over to the market", "a christian walked over to the market"])
    gap = []
    for penalty in (0.0, 20.0):
        s = {r.doc_id: r.score for r in toxicity.score(probe, toxicity.train(sample, 0.5, counterfactual=penalty)).collect()}
        gap.append(abs(s[0] - s[1]))
    assert gap[0] > 0.1 and gap[1] < 0.3 * gap[0]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_one_class_none_and_awkward_texts(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, awkward_texts())
    for labels in (none, one):
        out = (quality.judge if module is quality else toxicity.score)(d, module.fit(d, labels))
        assert out.count() == len(awkward_texts())
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), none)).collect() == []
    rows = toxicity.score(d, toxicity.fit(d, none)).collect()
    assert all(0 <= r.score <= 1 for r in rows)


NEUTRAL = {
    "en": ("the {} met at the market and talked about the weather", ("muslims", "christians", "jews", "hindus")),
    "de": ("die {} trafen sich am Markt und sprachen über das Wetter", ("muslime", "christen", "juden", "hindus")),
    "fr": ("les {} se sont retrouvés au marché et ont parlé du temps", ("musulmans", "chrétiens", "juifs")),
    "es": ("los {} se reunieron en el mercado y hablaron del tiempo", ("musulmanes", "cristianos", "judíos")),
}


def test_neutral_mentions_of_groups_in_four_languages(spark):
    """Abuse in the labelled rows names one group of each language far more often than the others: neutral sentences about it aren't rejected."""
    rng = random.Random(12)
    rows = []
    for lang, (frame, terms) in NEUTRAL.items():
        for i in range(240):
            bad = i % 2 == 0
            term = terms[0] if rng.random() < (0.9 if bad else 0.1) else rng.choice(terms[1:])
            words = frame.format(term).split()
            rng.shuffle(words)
            rows.append((len(rows), int(bad), " ".join(words + ["wretchling scumbag"] * (bad and rng.random() < 0.7))))
    sample = spark.createDataFrame(rows, "doc_id long, label int, text string")
    probe = [frame.format(t) for frame, terms in NEUTRAL.values() for t in terms]
    rejected = {}
    for penalty in (0.0, 20.0):
        model = toxicity.train(sample, 0.5, counterfactual=penalty)
        rejected[penalty] = sum(r.score >= 0.5 for r in toxicity.score(docs(spark, probe), model).collect())
        abuse = [r.score for r in toxicity.score(docs(spark, [p + " wretchling scumbag" for p in probe]), model).collect()]
        assert sum(s >= 0.5 for s in abuse) >= 0.9 * len(abuse)
    assert rejected[0.0] >= 4 and rejected[20.0] == 0, rejected


def test_scores_against_plain_arithmetic(spark):
    """The score is the sigmoid of the bias and the weights of the distinct tokens and prefixes that the model has."""
    import math

    d, labels, rows, _ = labelled(spark, 200)
    model = toxicity.fit(d, labels, per_class=60)
    weight = dict(zip(model[0].tolist(), model[1].tolist()))
    texts = rows[:40] + awkward_texts(5)
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        tokens = {x for x in re.findall(rb"[0-9A-Za-z\x80-\xff']+", (t or "").encode())}
        tokens = {x.lower() if x.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in tokens}
        found = set()
        for token in tokens:
            for k in (0, *toxicity.PREFIXES):
                if k < len(token) or not k:
                    part = np.frombuffer(token[:k] if k else token, np.uint8)
                    found.add(int(range_hashes(part, np.array([0]), np.array([len(part)]), k)[0]) % toxicity.BUCKETS)
        z = model[2] + sum(weight.get(b, 0.0) for b in found)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-4, t
