import hashlib

import public_tokenizers as P
import tiktoken

from readweaver.llm import bpe
from tests.llm.fixtures import awkward_texts, docs, empty

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = awkward_texts(7, 300) + ["it's we're 'twas''s 'S we'll I'd", "a" * 3000, "anan" * 200, " 's", "x  's", "\r\n\r\n a"]


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_the_library_and_round_trip(spark):
    coded = bpe.encode(docs(spark, TEXTS), PATH)
    got = {r.doc_id: r.ids for r in coded.collect()}
    enc = library()
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i] == enc.encode_ordinary(t or ""), t
    back = {r.doc_id: bytes(r.data).decode() for r in bpe.decode(coded, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_query_digests(spark, tmp_path):
    docs(spark, TEXTS[:60]).write.parquet(f"{tmp_path}/documents.parquet")
    enc = library()
    for r in bpe.op7_byte_bpe(spark, str(tmp_path)).collect():
        t = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_lexicon_forgets_beyond_its_bound():
    import pyarrow as pa

    lexicon = bpe._codec(PATH)[0]
    lexicon.clear()
    lexicon.most = 5
    try:
        for _ in range(3):
            out = [ids.tolist() for *_, ids, _ in bpe.encode_batch(pa.array(["one two three four five six seven"]), PATH)]
            assert out == [library().encode_ordinary("one two three four five six seven")]
    finally:
        lexicon.most = 1_000_000


def test_empty_table(spark):
    assert bpe.digests(empty(spark), PATH).collect() == []
