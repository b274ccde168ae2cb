import hashlib

import public_tokenizers
import pytest
import tiktoken

from staycheck.llm import bpe
from staycheck.llm.queries import BPE_FILE, op2_bpe

SF = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(public_tokenizers.path(BPE_FILE))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(RANKS)


def test_perfect_hash(vocabulary):
    slots = {vocabulary.table.slot(k) for k in RANKS}
    assert len(slots) == len(RANKS) and max(slots) == len(RANKS) - 1
    assert all(vocabulary.rank(k) == r for k, r in RANKS.items())
    assert vocabulary.rank(b"\xff\xfenot there") is None and vocabulary.rank(b"") is None


def test_query_against_library(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_bpe(spark, SF).collect()}
    assert got == want


def test_odd_texts(spark, library, vocabulary):
    texts = ["", None, " ", "  \n\n\t x", "<|endoftext|>", "it's IT'S we'll", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 400, "日本語テスト 漢字",
             "a b c​d\x1ce\x1d \x85f\x0b\x0cg", "½²³ⅷ٣", "🙂🙃 é", "x" * 3 + "\x00" + "y", "\r\n \r\n", "ſK İi",
             "!?" * 5000, "foo  bar   ", "12345678901234567890"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "ab", "y"), (None, "ab", "y")],
                               "doc_id long, text string, ids string")
    out = bpe.encode(df, vocabulary, public_tokenizers.PATTERN)
    got = {r.doc_id: r.ids for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == library.encode_ordinary(t or ""), repr(t)[:40]
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(out, vocabulary).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    both = bpe.round_trip(df, vocabulary, public_tokenizers.PATTERN).where("doc_id is not null").collect()
    assert [(r.ids, bytes(r.decoded)) for r in sorted(both)] == [(got[i], (t or "").encode()) for i, t in enumerate(texts)]
    assert out.count() == len(texts) + 2 and bpe.encode(df.limit(0), vocabulary, public_tokenizers.PATTERN).count() == 0
