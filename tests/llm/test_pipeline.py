import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from cases import ODD
from ferryline.llm import ann, common, langid, packing, queries, secrets, simhash, substrings, topk, toxicity
from ferryline.llm.toxicity import judge_texts
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SECRET = "aB3dEfGh1jKlMnOpQrStUvWx" * 2


def corpus():
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, t, lang, "s", len(t) if t is not None else None) for d, t, lang in ODD]
    rows += [(100 + i, " ".join(f"clean{(i * 7 + j) % 50}" for j in range(30)), "en", "s", 0) for i in range(60)]
    rows += [(200 + i, f"vile nasty awful clean{i} vile nasty", "en", "s", 0) for i in range(20)]
    rows += [(300 + i, f"{passage} tail{i} a b c d", "en", "hot", 0) for i in range(5)]
    rows += [(400, f"password={SECRET} and AKIAABCDEFGHIJ then password={SECRET}", "en", "s", 0), (401, "ä\U0001f600 token: abcdefghijklmn end", "en", "s", 0)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(corpus(), schema).selectExpr("*", "1 as number", "'x' as row", "2 as block", "'y' as score").write.parquet(f"{path}/documents.parquet")
    labels = [(d, 1, int(200 <= d < 300)) for d, *_ in corpus() if d is not None and 100 <= d < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


def stage(spark, folder, name, docs=None):
    docs = docs if docs is not None else spark.read.parquet(f"{folder}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert name == "packing" or out.columns == COLUMNS
    return out.collect()


def test_toxic_documents_go(spark, folder, nothing):
    kept = [r.doc_id for r in stage(spark, folder, "toxicity")]
    want = sorted((d for d, *_ in corpus() if d is None or not 200 <= d < 300), key=str)
    assert sorted(kept, key=str) == want
    assert stage(spark, nothing, "toxicity") == []
    assert len(stage(spark, nothing, "toxicity", spark.read.parquet(f"{folder}/documents.parquet"))) == len(corpus())


def test_one_of_each_group_stays(spark, folder, nothing):
    fps = {}
    for d, text, *_ in corpus():
        fps.setdefault(simhash.fingerprint(text), []).append(d)
    group = {f: f for f in fps}
    for a in fps:  # brute force over all pairs
        for b in fps:
            if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {f: new if g == old else g for f, g in group.items()}
    want = []
    for g in set(group.values()):
        ids = [d for f in fps if group[f] == g for d in fps[f]]
        want.append(min((d is None, d or 0, d) for d in ids)[2])
    assert sorted((r.doc_id for r in stage(spark, folder, "near_copies")), key=str) == sorted(want, key=str)
    assert stage(spark, nothing, "near_copies") == []


def test_repeats_go(spark, folder, nothing):
    seen, want = set(), {}
    order = sorted(corpus(), key=lambda r: (r[0] is None, r[0] or 0))
    for d, text, *_ in order:
        words = (text or "").split()
        gone = set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        want.setdefault(d, []).append(" ".join(w for i, w in enumerate(words) if i not in gone) if gone else text)
    got = {}
    for r in stage(spark, folder, "repeats"):
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.lang is not None or r.doc_id in (3, None)
    assert {d: sorted(map(str, t)) for d, t in got.items()} == {d: sorted(map(str, t)) for d, t in want.items()}
    assert stage(spark, nothing, "repeats") == []


def test_secrets_are_blanked(spark, folder, nothing):
    got = {r.doc_id: r for r in stage(spark, folder, "secrets")}
    assert got[400].text == "[secret] and [secret] then [secret]" and got[400].n_chars == len(got[400].text)
    assert got[401].text == "ä\U0001f600 [secret] end" and got[3].text is None and got[2].text == ""
    assert got[100].text == dict((d, t) for d, t, *_ in corpus())[100] and got[100].n_chars == 0
    assert stage(spark, nothing, "secrets") == []


def test_blanking_of_overlaps(spark):
    text = "é" + "".join(chr(97 + i % 26) for i in range(200))
    spans = [(0, 0, 2), (1, 1, 5), (5, 1, 6), (10, 0, 40), (12, 2, 20), (39, 2, 41), (199, 0, 201)]
    raw = [(s, k, e, len(text[:s].encode()), len(text[:e].encode())) for s, k, e in spans]
    df = spark.createDataFrame([(text, raw), (text, []), (None, [])], "text string, spans array<struct<start:int,kind:int,end:int,low:int,high:int>>")
    got = [r.x for r in df.select(secrets.blanked(F.col("text"), F.col("spans"), "#").alias("x")).collect()]
    covered = {i for s, _, e in spans for i in range(s, e)}
    want = re.sub("\0+", "#", "".join("\0" if i in covered else c for i, c in enumerate(text)))
    assert got == [want, text, None]


def test_stages_leave_other_frames_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = simhash.near_groups(docs)
    scan = secrets.scan(docs)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert held.count() == len(corpus()) and scan.count() == len(corpus())
    ids = {r.doc_id for r in rows}
    assert not any(d is not None and 200 <= d < 300 for d in ids) and {r.length > 0 for r in rows} == {True}
    common.release(held)
    common.release(scan)


def test_released_tables_are_gone(spark, folder):
    shared = Path(common.shared_folder(spark).removeprefix("file://")) / "ferryline"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = set(shared.iterdir())
    found = substrings.remove_repeats(docs)
    assert found.count() == len(corpus())
    common.release(found)
    assert set(shared.iterdir()) == before
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, folder)
    assert kept.count() > 0 and set(shared.iterdir()) > before
    common.release(kept)
    assert set(shared.iterdir()) == before


COLUMNS_OF = {
    "op1_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op2_lm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op3_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op4_simhash": {"doc_id", "fingerprint", "component_id"}, "op5_topk": {"query_id", "rank", "vec_id", "score"}, "op6_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op7_ann": {"query_id", "rank", "vec_id", "score"},
    "op8_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op9_substrings": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op10_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_on_odd_rows_and_on_none(spark, folder, nothing, name):
    df = queries.QUERIES[name](spark, folder)
    rows = df.collect()
    assert COLUMNS_OF[name] <= set(df.columns)
    if name not in ("op5_topk", "op7_ann"):
        assert sorted({r.doc_id for r in rows}, key=str) == sorted({d for d, *_ in corpus()}, key=str)
        assert name == "op8_packing" or len(rows) == len(corpus())
    else:
        assert [(r.query_id, r["rank"]) for r in sorted(rows)] == [(q, k) for q in (0, 50, 100) for k in range(1, 6)]
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_toxicity_query_against_brute_force(spark, folder):
    """The score of each row is the curve over the vote of the exact nearest examples, by a plain product with all of them."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    index = toxicity.learn(docs, labels.filter(common.crc_mod(F.col("doc_id"), 3) != 1))
    whole = np.concatenate([m.T for m, _ in index["blocks"]])
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    for d, text, *_ in corpus():
        at, q = toxicity.query(index, text or "")
        s = whole[:, at] @ q
        top = [i for i in np.lexsort((np.arange(len(s)), -s))[: toxicity.K] if s[i] > 0]
        share = index["rate"]
        if top:
            w = (s[top] / s[top[0]]) ** 2 * index["stands_for"][index["y"][top]] / index["stands_for"].max()
            share = ((w * index["y"][top]).sum() + toxicity.PRIOR * index["rate"]) / (w.sum() + toxicity.PRIOR)
        assert abs(got[d].score - toxicity.curved(index, share)) < 1e-9
        assert len(got[d].evidence) == min(len(top), toxicity.SHOWN)
        if top:  # the nearest is among those named, up to ties
            assert max(float(whole[np.flatnonzero(index["name"] == e)[0]][at] @ q) for e in got[d].evidence) == pytest.approx(float(s[top[0]]))
    assert judge_texts(index, ["vile nasty"], {})[0][0] > 0.7


def test_languages_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = {f"l{k:02d}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(12)] for k in range(9)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 9:02d}"], 8)), f"l{i % 9:02d}") for i in range(90)]
    df = spark.createDataFrame([*rows, (90, "1 2", "l00"), (91, None, None)], "doc_id long, text string, lang string")
    counts, priors = {}, {}
    for _, t, lang in rows:
        priors[lang] = priors.get(lang, 0) + 1
        for _, b, _, _ in langid.grams([t]):
            counts[lang] = counts.get(lang, 0) + np.bincount(b.ravel(), minlength=1 << langid.BITS)
    model = {x: np.log(c + 0.5) - np.log(c.sum() + 0.5 * (1 << langid.BITS)) for x, c in counts.items()}
    runs = []
    for shard in (langid.SHARD, 2 << langid.BITS):  # one shard, then five
        monkeypatch.setattr(langid, "SHARD", shard)
        got = {r.doc_id: r for r in langid.identify(df, df.filter("doc_id < 90")).collect()}
        assert got[90].lang_pred == got[91].lang_pred == "und" and got[90].score == 0
        for i, t, _ in rows:
            total = {x: sum(m[b].sum() for _, b, _, _ in langid.grams([t])) + np.log(priors[x] / 90) for x, m in model.items()}
            best = max(total, key=total.get)
            assert got[i].lang_pred == best and abs(got[i].score - 1 / sum(np.exp(v - total[best]) for v in total.values())) < 1e-4
        runs.append({i: r.lang_pred for i, r in got.items()})
    assert runs[0] == runs[1]


def test_vectors_of_many_kinds(spark):
    """Ties, repeated identifiers, several lengths, clashing columns."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((i, [1.0, 0.5]) for i in range(1, 8)), (50, [2.0, 1.0, 0.0]), (51, [2.0, 1.0, 0.5]), (52, [0.0, 0.0, 1.0]), (60, []), (None, [1.0, 1.0]), (61, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as part", "4 as score")
    a = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(df).collect()}
    assert [a[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [a[50, 1], a[50, 2]] == [51, 52] and (50, 3) not in a
    t = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df).collect()}
    assert [t[0, k] for k in range(1, 6)] == [(i, 128 * 256) for i in (1, 2, 3, 4, 5)] and t[50, 1] == (51, 512 * 512 + 256 * 256) and (50, 3) not in t


def test_products_beyond_doubles_are_exact():
    q, x = np.array([[512000001, 3]]), np.array([[1023999999, 5], [1024000001, -7]])
    assert topk.products(x, q)[:, 0].tolist() == [512000001 * 1023999999 + 15, 512000001 * 1024000001 - 21]
    assert [list(s) for _, s, _, _ in topk.best(q, np.array([9]), np.array([-np.inf]), x, np.array([1, 2]), 1)] == [[512000001 * 1024000001 - 21]]


def test_few_parts_are_probed_where_vectors_have_clusters():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(64, 32))
    x = centres[rng.integers(0, 64, 4096)] + 0.15 * rng.normal(size=(4096, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w, _, probes = ann.learn(x, 1_000_000, 5, ann.TARGET)
    assert w.shape[1] == 256 and probes <= 26  # a tenth of the parts


def test_a_long_text_of_secrets(spark):
    n = 60_000
    text = " ".join(f"deadbeef{i:08x}" for i in range(n))
    found = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), wide=True)
    assert tuple(found.select(F.element_at("base", -1).alias("s")).first()["s"])[:3] == (len(text) - 16, 2, len(text)) and found.select(F.size("base")).first()[0] == n
    clean = found.withColumn("text", F.lit(text)).select(secrets.blanked(F.col("text"), F.col("base"), "#").alias("c")).first()["c"]
    assert clean == " ".join(["#"] * n)


def test_word_hashes_of_long_words():
    text = b"a bb  " + b"x" * 70 + b"\t" + b"y" * (substrings.PIECE + 5) + b" end " + b"z " * 10
    h = substrings.word_hashes(text)
    words = text.split()
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words)) and substrings.word_hashes(b"bb")[0] == h[1]


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["x" * 10, None, "y" * 50, "z" * 3, "w" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["i", "t"])
    assert [b.num_rows for b in common.portions(batch, 1, rows=3, size=20)] == [2, 1, 2] and packing.MEMO_ENTRIES > 0


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.select("vec_id", "embedding").toArrow()
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = asked = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        hit += len({int(ids[j]) for j in np.lexsort((ids, -s))[:5]} & got[int(ids[i])])
        asked += 5
    assert hit / asked >= 0.9


def test_blocks_and_sections_do_not_matter_to_the_model(spark, monkeypatch):
    from ferryline.llm import lm
    from test_operators import brute_ctw

    rows = [(i, " ".join(f"w{(i * j) % 5}" for j in range(6)), "en") for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7, "doc_id")
    one = {r.doc_id: r for r in lm.score(df.coalesce(1), F.col("doc_id") % 3 != 0).collect()}
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "SECTION_BYTES", 40)
    many = {r.doc_id: r for r in lm.score(df, F.col("doc_id") % 3 != 0).collect()}
    train = [lm.line(t) for d, t, _ in rows if d % 3]
    for d, t, _ in rows[:4]:
        assert abs(many[d].score - brute_ctw(train, lm.line(t))) < 1e-6
    for d, r in one.items():
        assert abs(r.score - many[d].score) < 1e-9 and abs(r.base_score - many[d].base_score) < 1e-12 and r[1:5] == many[d][1:5]
