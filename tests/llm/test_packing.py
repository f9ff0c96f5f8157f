import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cases import ODD, documents
from ferryline.llm import packing

PATH = P.path("word_bpe_49k.json")


def check(rows, want, capacity):
    """rows: (doc, start, length, crc, total, sequence, offset); want: the ids of each document."""
    docs, windows = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, seq, offset in rows:
        ids = want[doc]
        assert total == len(ids) and length > 0
        assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        docs[doc].append((start, length))
        windows[seq].append((offset, length))
    for doc, ids in want.items():
        at = 0
        for start, length in sorted(docs[doc]):
            assert start == at
            at += length
        assert at == len(ids)
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(2, 12))
def test_packer_never_pads(lengths, max_open):
    p = packing.SumOfSquares(32, max_open)
    want = {i: [i * 1000 + j for j in range(n)] for i, n in enumerate(lengths)}
    done = []
    for i, ids in want.items():
        done += p.take(i, np.array(ids, "<u4").tobytes())
        assert p.n_open == int(p.levels[1:].sum()) == sum(map(len, p.open)) <= max_open
    done += p.close()
    rows = []
    for s, w in enumerate(done):
        at = 0
        for doc, start, ids, total in w.pieces:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, s, at))
            at += len(ids) // 4
    check(rows, want, 32)


def test_level_is_the_least_sum_of_squares():
    p = packing.SumOfSquares(16, 1000)
    rng = np.random.default_rng(1)
    for i in range(400):
        n = int(rng.integers(1, 16))

        def cost(level):
            after = p.levels.copy()
            after[level] -= level > 0
            after[level + n] += 1
            return int((after[1:16] ** 2).sum())

        options = [0] + [h for h in range(1, 16 - n + 1) if p.levels[h]]
        assert cost(p.level_for(n)) == min(map(cost, options))
        p.take(i, b"\0\0\0\0" * n)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_operator_on_odd_rows(spark, capacity):
    t = Tokenizer.from_file(PATH)
    rows = [r for r in ODD if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    want = {d: t.encode(x or "", add_special_tokens=False).ids + [2] for d, x, _ in rows}
    got = packing.pack(documents(spark, rows), PATH, capacity=capacity).collect()
    check([tuple(r) for r in got], want, capacity)
    assert packing.pack(documents(spark, []), PATH).count() == 0
    assert packing.pack(documents(spark), PATH).filter("doc_id is null").agg({"length": "sum"}).first()[0] > 4


def test_words_tokenise_as_whole_texts():
    t = Tokenizer.from_file(PATH)
    w = packing.WordTokenizer(PATH, 2)
    for x in ["It's a  test\n\tof 'll we'll", "Áb ́c", "x\x1cy \x85 z w", "<|endoftext|>a <|startoftext|>", "ΑΣ ΟΔΟΣ. İI", "a b " * 50]:
        assert np.frombuffer(w.ids([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids + [2], x


def test_plain_words_are_told_apart():
    t = Tokenizer.from_file(PATH)
    w = packing.WordTokenizer(PATH, 2)
    words = [f"{a}{b}{c}" for a in ("the", "Straße", "ÀÉî", "zqxj") for b in ("", "ing", "ñandú") for c in ("", ".", "...", ",;", "!?")]
    assert np.frombuffer(w.ids([" ".join(words)])[0], "<u4").tolist() == t.encode(" ".join(words), add_special_tokens=False).ids + [2]
    assert w.closes.sum() > 1000


def test_long_texts_between_short_ones():
    t, w = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH, 2)
    w.memo = packing.common.Memo(40)
    texts = ["a b c", " ".join(f"x{i}" for i in range(130)), None, "", "a b", " ".join(f"y{i}" for i in range(39)), "z"]
    assert [np.frombuffer(x, "<u4").tolist() for x in w.ids(texts)] == [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    assert w.ids([]) == []
