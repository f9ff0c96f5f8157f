import hashlib
import math
import random
import string
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from cases import ODD, documents
from ferryline.llm import ann, langid, lm, secrets, simhash, substrings, topk, toxicity
from ferryline.llm.common import crc_mod
from pyspark.sql import functions as F


def texts(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    passage = [rng.choice(vocab) for _ in range(70)]
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        if i % 3 == 0:
            a = rng.randrange(0, 40)
            words[5:5] = passage[a : a + rng.randrange(15, 50)]
        out.append((i, " ".join(words), "en"))
    return out + [(n, "w1 " * 60, "en"), (n + 1, out[0][1], "en"), (n + 2, out[3][1] + " extra", "en")]


def test_repeats_against_brute_force(spark):
    rows = texts()
    got = {r.doc_id: r for r in substrings.remove_repeats(documents(spark, rows)).collect()}
    seen = set()
    for doc, text, _ in rows:
        words = text.split()
        gone = set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept) == (len(words), len(gone), kept)


def test_repeats_on_odd_rows(spark):
    got = substrings.remove_repeats(documents(spark)).collect()
    assert len(got) == 9 and {r.doc_id: r.n_removed for r in got}[5] == 4999
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def near_rows(n=300):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(200)] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(base[i % 12])
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(200)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w), "en"))
    return rows


@pytest.mark.parametrize("chunk", [8192, 40])
def test_near_groups_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash.links, "__kwdefaults__", {"max_bits": 4, "chunk": chunk})
    rows = near_rows()
    fp = [simhash.fingerprint(t) for _, t, _ in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4 and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    got = {r.doc_id: r for r in simhash.near_groups(documents(spark, rows)).collect()}
    assert [got[i].component_id for i in range(len(rows))] == comp
    assert [got[i].fp & (2**64 - 1) for i in range(len(rows))] == fp


def test_fingerprint_bits():
    for t in ["A b C d e f", "one two", "x", "", None, "a b c d"]:
        words = (t or "").lower().split()
        k = min(4, len(words))
        hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash.fingerprint(t) == want


def test_links_of_a_large_group_are_whole():
    rng = np.random.default_rng(2)
    fps = np.unique(np.array([np.bitwise_xor.reduce(np.array([1 << int(b) for b in rng.choice(64, rng.integers(0, 6))], np.uint64), initial=np.uint64(0)) for _ in range(300)], np.uint64)).view(np.int64)
    forest, full = simhash.Forest(), simhash.Forest()
    simhash.link_large(fps, forest, 4)
    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) % 2**64 ^ int(fps[j]) % 2**64).bit_count() <= 4:
                full.join(int(fps[i]), int(fps[j]))
    assert [forest.root(int(x)) for x in fps] == [full.root(int(x)) for x in fps]


def test_near_groups_on_odd_rows(spark):
    got = simhash.near_groups(documents(spark)).collect()
    zero = {r.doc_id for r in got if r.fp == 0}
    assert len(got) == 9 and zero == {2, 3, 6} and {r.component_id for r in got if r.doc_id in zero} == {2}
    assert simhash.near_groups(documents(spark, [])).count() == 0


def test_secrets_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["password", "Token", "api_key", "SECRET", ":", "=", " = ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef01234567", "é", "\U0001f600", " ", "\n", "x", "abcdefghijkl", "https://u:p@h.example", "aB3dEfGh1jKlMnOpQrStUvWx"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))), "en") for i in range(300)]
    A = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in secrets.scan(documents(spark, rows)).collect()}
    for doc, t, _ in rows:
        want = [(m.start(), 0, m.end()) for m in A.finditer(t) if len(m[1]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert sorted(map(tuple, got[doc].base)) == sorted(want), t


def test_weak_parts_need_a_partner(spark):
    secret = "aB3dEfGh1jKlMnOpQrStUvWx"
    rows = [(1, f"id AKIAABCDEFGHIJ key {secret} end", "en"), (2, f"only {secret} here", "en"), (3, f"AKIAABCDEFGHIJ {'x ' * 400}{secret}", "en"), *[(d + 10, t, x) for d, t, x in ODD if d is not None]]
    got = {r.doc_id: r for r in secrets.scan(documents(spark, rows)).collect()}
    assert sorted(s.kind for s in got[1].extra) == [3, 4] and not got[2].extra and not got[3].extra and not got[12].base
    assert secrets.scan(documents(spark, [])).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    rows = [(i, [float(a) for a in x[i]]) for i in range(700)]
    df = spark.createDataFrame(rows + [(700, None), (800, [float("nan")] * 8), (850, [None] * 8)], "vec_id long, embedding array<float>")
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df).collect()}
    n = 0
    for q in range(0, 700, 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        for k, i in enumerate(order, 1):
            assert got[q, k] == (i, s[i])
            n += 1
    assert n == len(got)
    assert topk.search(df.limit(0)).count() == 0


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 2000)] + 0.4 * rng.normal(size=(2000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(2000)] + [(2000, None), (2050, [0.0] * 16)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 2000, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len({int(i) for i in np.argsort(-s)[:5]} & {v for _, v, _ in got[q]})
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in got[q])
    assert hit / 200 >= 0.9 and set(got) == set(range(0, 2000, 50))
    assert ann.search(df.limit(0)).count() == 0


def test_toxic_neighbours_are_exact():
    rng = random.Random(3)
    bad = ["vile", "nasty", "awful"]
    ex = [(" ".join([rng.choice(["a", "b", "c", "d"]) for _ in range(30)] + [rng.choice(bad) for _ in range(4 * (i % 5 == 0))]), int(i % 5 == 0)) for i in range(900)]
    index = toxicity.build(ex)
    full = np.concatenate([m.T for m, _ in index["blocks"]])
    q = np.zeros(len(index["number"]))
    for w in bad:
        q[index["number"][w]] = index["weight"][index["number"][w]]
    q /= np.linalg.norm(q)
    s, _, _, opened = toxicity.neighbours(index, q)
    assert np.allclose(s, np.sort(full @ q)[::-1][: len(s)]) and opened >= 1
    memo = {}
    assert toxicity.score_text(index, "b vile nasty", memo) > 0.7 > toxicity.score_text(index, "a b c d", memo)
    assert 0 <= toxicity.score_text(index, None, memo) < 0.7
    assert toxicity.score_text(toxicity.build([]), "x", {}) == 0


def test_languages_and_und(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de") for i in range(40)]
    model = langid.train(documents(spark, rows))
    got = {r.doc_id: r for r in langid.predict(documents(spark, rows + [(90, "123 !", "en"), (91, None, "en"), (92, "x" * (1 << 21), "en")]), model).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(40)) and got[90].lang_pred == got[91].lang_pred == "und"
    assert got[92].lang_pred in ("de", "en") and 0 <= got[92].score <= 1
    assert langid.predict(documents(spark), langid.train(documents(spark, []))).filter("lang_pred <> 'und'").count() == 0


def brute_ctw(train, text, depth=lm.DEPTH):
    """Sequential definition: log10 probability of the text under the tree learned from ``train``."""
    counts = {}

    def steps(s):
        x = bytes([255]) * depth + s
        for t in range(depth, len(x)):
            for i in range(8):
                yield x[t - depth : t][::-1], (256 + x[t]) >> (8 - i), x[t] >> (7 - i) & 1

    for s in train:
        for ctx, node, bit in steps(s):
            for d in range(depth + 1):
                counts.setdefault((ctx[:d], node), [0, 0])[bit] += 1
    kids = {}
    for ctx, node in counts:
        if ctx:
            kids.setdefault((ctx[:-1], node), []).append((ctx, node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def lw(k):
        if k not in memo:
            own = kt(*counts[k])
            memo[k] = own if len(k[0]) == depth else np.logaddexp(own, sum(map(lw, kids[k]))) - math.log(2)
        return memo[k]

    total = 0.0
    for ctx, node, bit in steps(text):
        p, left, near = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            k = (ctx[:d], node)
            if k not in counts:
                break
            a, b = counts[k]
            near = (b + 0.5) / (a + b + 1)
            w = 1.0 if d == depth else min(1.0, math.exp(kt(a, b) - math.log(2) - lw(k)))
            p += left * w * near
            left *= 1 - w
        p += left * near
        total += math.log10(p if bit else 1 - p)
    return total


def test_lm_against_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat sat", "The  dog sat on\nthe cat", "a cat", "zebra é", "", "the the the"])]
    got = {r.doc_id: r for r in lm.score(documents(spark, rows), F.col("doc_id") % 3 != 0).collect()}
    train = [lm.line(t) for d, t, _ in rows if d % 3]
    words = Counter(w for d, t, _ in rows if d % 3 for w in [*t.lower().split(), ""])
    n, v = sum(words.values()), len(words)
    for d, t, _ in rows:
        tokens = [*t.lower().split(), ""]
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(tokens), sum(w in words for w in tokens), n)
        assert abs(got[d].base_score - sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)) < 1e-9
        assert abs(got[d].score - brute_ctw(train, lm.line(t))) < 1e-6, (t, got[d].score, brute_ctw(train, lm.line(t)))
    assert lm.score(documents(spark), crc_mod(F.col("doc_id"), 5) != 1).count() == 9
    assert lm.score(documents(spark, []), F.lit(True)).count() == 0


def test_rare_toxic_wording_is_kept_at_full_sample(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(12)) + (" zorn" if i < 10 else ""), "de") for i in range(9000)]
    docs = spark.createDataFrame(rows + [(9000, "zorn w1 w2", "de"), (9001, "w1 w2 w3", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(9000)], "doc_id long, toxic int")
    index = toxicity.learn(docs, labels)
    assert index["y"].sum() == 10 and abs(index["rate"] - 10 / 9000) < 1e-12
    got = {r.doc_id: r.score for r in toxicity.score(docs.filter("doc_id >= 9000"), index).collect()}
    assert got[9001] < 0.1 < 0.25 < got[9000]


def test_a_repeated_labelled_text_takes_one_place(spark):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(30)] + [(2, "two"), (3, "three")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    assert sorted(toxicity.learn(docs, labels, max_examples=4)["y"]) == [0, 0, 1]



def test_every_word_counts_in_a_toxic_text():
    rng = random.Random(12)
    ex = [(" ".join(f"{'bad' if i % 2 else 'good'}{rng.randrange(400)}" for _ in range(5)), i % 2) for i in range(1200)]
    index, memo = toxicity.build(ex), {}
    assert all(toxicity.score_text(index, t, memo) > 0.7 for t, y in ex if y)
    for text in ("bad7 good9 bad11", "bad1 bad2 unknown"):
        at, q = toxicity.query(index, text)
        full = np.concatenate([m.T for m, _ in index["blocks"]])
        want = np.sort(full[:, at] @ q)[::-1][: toxicity.K]
        for worth in (0, 1e9):
            toxicity.WORTH, was = worth, toxicity.WORTH
            assert np.allclose(toxicity.nearest(index, at, q)[0], want[want > 0])
            toxicity.WORTH = was


def test_weak_secrets_of_any_length_after_equals_or_padded(spark):
    secret, ident = "aB3dEfGh1jKlMnOpQrStUvWx" + "yZ0aB3dEfGh1jKlM", "AKIAABCDEFGHIJ"
    forms = [f"aws_secret_access_key={secret}", f"key {secret}==", f"key {secret * 3}", f"key {'a' * 70}B1"]
    rows = [(i, f"{ident} {f} end", "en") for i, f in enumerate(forms)] + [(8, f"secret={secret} {ident}", "en")]
    got = {r.doc_id: r for r in secrets.scan(documents(spark, rows)).collect()}
    for i, f in enumerate(forms):
        value = f.split(" ")[-1].removeprefix("aws_secret_access_key=")
        start = rows[i][1].index(value)
        assert sorted(map(tuple, got[i].extra)) == [(0, 3, 14), (start, 4, start + len(value))], f
    assert [s.kind for s in got[8].base] == [0] and [s.kind for s in got[8].extra] == [3]


def test_endpoints_of_any_form_and_gaps_between_ends(spark):
    ident = "AKIAABCDEFGHIJ"
    forms = ["https://host.example/path", "https://host.example:8443", "postgres://db.example/x", "redis://:p%40ss!@cache:6379/0", "mysql://u:p@10.0.0.1:3306", "db.example:5432", "10.0.0.1:5432"]
    rows = [(i, f"{f} {ident}", "en") for i, f in enumerate(forms)]
    rows += [(20, f"token={'ab1-' * 150} {ident}", "en"), (21, f"{ident} {'x ' * 99}https://host.example/{'p' * 700} {'x ' * 99}{ident}", "en"), (22, f"{ident} {'x ' * 101}https://host.example", "en"), (23, "see https://host.example at 10:30", "en")]
    got = {r.doc_id: r for r in secrets.scan(documents(spark, rows)).collect()}
    for i, f in enumerate(forms):
        assert sorted(map(tuple, got[i].extra)) == [(0, 5, len(f)), (len(f) + 1, 3, len(f) + 15)], f
    assert [s.kind for s in got[20].extra] == [3] and sorted(s.kind for s in got[21].extra) == [3, 3, 5]
    assert not got[22].extra and not got[23].extra


def shuffled(spark):
    """Bytes and rows that the stages known so far have shuffled, and their tasks."""
    gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    nothing = gateway.jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
    return {(s.stageId(), s.attemptId()): (s.shuffleWriteBytes(), s.shuffleWriteRecords(), s.numTasks()) for s in (stages.apply(i) for i in range(stages.size()))}


def test_learning_shuffles_labelled_texts_only(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "".join(rng.choices(string.ascii_letters, k=2000))) for i in range(4000)], "doc_id long, text string").repartition(4).localCheckpoint()
    labels = spark.createDataFrame([(i, i // 10 % 2) for i in range(0, 1000, 10)] + [(1, None)], "doc_id long, toxic int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        index = toxicity.learn(docs, labels, max_examples=20)
        moved = sum(n[0] for k, n in shuffled(spark).items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(index["y"]) == 20 and moved < 1e6  # of 8 MB of texts 0.2 are labelled


def test_every_labelled_row_passes_the_set_of_bits(spark):
    texts = spark.createDataFrame([(i, "t") for i in range(-500, 3000)] + [(None, "t")], "id long, text string")
    ids = texts.filter("id % 7 = 0").select("id").union(texts.filter("id = 14").select("id"))
    for most, others in ((1 << 26, 300), (64, 4000)):
        got = [r.id for r in toxicity.likely(texts, ids, most).collect()]
        assert set(range(-497, 3000, 7)) <= set(got) and len(got) == len(set(got)) and len(got) < 500 + others
    assert toxicity.likely(texts, ids.limit(0)).count() == 0


def test_words_without_the_pattern():
    for text in ("", " ", "aB1_c\x00d\x1fE\x7f", "A-b\nC\td'e", "x\x1cy\x0bz", "Straße Ünï 1a", "İI"):
        assert toxicity.words(text) == toxicity.WORD(text.lower())


def test_a_task_indexes_a_bounded_number_of_fingerprints(spark):
    nodes = spark.range(40000).coalesce(1).select(F.xxhash64("id").alias("fp"))
    before = shuffled(spark)
    assert simhash.links(nodes).filter("a = b").count() == 0
    made = [n for k, n in shuffled(spark).items() if k not in before and n[1] >= 64 * 40000]
    assert made and all(rows / tasks < 64 * 16384 for _, rows, tasks in made)
