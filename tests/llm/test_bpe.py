import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cases import documents
from ferryline.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    c = bpe.codec(PATH, P.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(encoder):
    c, _ = encoder
    p = c.perfect
    assert sorted(p.key_at.tolist()) == list(range(len(c.tokens)))
    assert p.find(c.tokens).tolist() == list(range(len(c.tokens)))
    assert all(k < 0 or c.tokens[k] != w for w, k in zip([b"zzzzqq", b"\xff\xff\xff"], p.find([b"zzzzqq", b"\xff\xff\xff"])))
    assert bpe.PerfectHash([]).find([b"a"]).tolist() == [-1]


def test_same_ids_as_the_library(encoder):
    c, lib = encoder
    rng = random.Random(3)
    alphabet = "abcdeéßñ  \n\t'stll0129.,!-中文ا\U0001f600  ́\x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3000, "x", "<|endoftext|>", "naïve ÉTÉ it's we'll"]
    for t in texts:
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t), t
        assert c.decode(ids) == t.encode()


def test_memo_may_overflow(encoder, monkeypatch):
    c, lib = encoder
    monkeypatch.setattr(c, "memo", bpe.common.Memo(50))
    text = " ".join(f"w{i}q{i % 7}" for i in range(500))
    assert np.frombuffer(c.encode(text), "<u4").tolist() == lib.encode_ordinary(text)


def test_operator_on_odd_rows(spark, encoder):
    _, lib = encoder
    got = bpe.encode_decode(documents(spark), PATH, P.PATTERN).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[3].ids == b"" and by[3].decoded == b"" and by[2].ids == b""
    assert bytes(by[5].decoded) == b"word " * 5000
    assert bpe.encode_decode(documents(spark, []), PATH, P.PATTERN).count() == 0


def test_query(spark, tmp_path, encoder):
    _, lib = encoder
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc, text, _ in __import__("cases").ODD:
        ids = lib.encode_ordinary(text or "")
        want[doc] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = bpe.op1_bpe(spark, str(tmp_path)).collect()
    assert len(got) == 9 and all(tuple(r)[1:4] == want[r.doc_id] for r in got)
