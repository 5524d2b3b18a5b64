"""Empty tables, nulls, repeated rows, extra columns with clashing names; plain versions of the models; the pipeline."""

import os
import sys
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tessera.llm import chat, common, decontaminate, jaccard, lm, neardup, packing, pii, quality, sampling, substring, toxicity

RNG = np.random.default_rng(21)
TEXTS = [None, "", " \n", "a", "the cat sat on the mat", "the cat sat on the mat", "Write to ann@example.org", "É" * 40, "w " * 2500]
EXTRA = "gone string, node string, id string, _id string, _gone string, unit string, tokens string, part string, label string, kind string, parts string, names string, made string, norm string"


@pytest.fixture(scope="module")
def tokenizer():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns whose names the operators use inside, a null id and a repeated row."""
    own = [c.split()[0] for c in EXTRA.split(", ")]
    rows = [(i, t, *[f"{c}{k}" for c in own]) for k, (i, t) in enumerate([*enumerate(TEXTS), (None, "no id here at all"), (4, TEXTS[4])])]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


def test_columns_stay_where_rows_are_returned(spark, clashing, tokenizer):
    bench = spark.createDataFrame([(1, "nothing of the kind stands here in any of these documents at all ever")], "item_id long, text string")
    model = quality.QualityModel(np.zeros(1 << 18), np.zeros(1 << 18), 0.0, 1.0, 0.0)
    n = clashing.count()
    for out in (quality.keep_good(clashing, model), decontaminate.reject_contaminated(clashing, bench), pii.replace_entities(clashing), jaccard.keep_one(clashing)):
        assert out.columns == clashing.columns
        rows = out.collect()
        assert all(r.gone.startswith("gone") and r.node.startswith("node") for r in rows) and len(rows) in (n, n - 2)
    assert lm.score_documents(clashing, tokenizer, least=1).count() == n
    assert substring.digest(substring.dedup_substrings(clashing)).count() == n
    assert jaccard.similar_documents(clashing).count() == n
    assert packing.pack_documents(clashing, tokenizer).select("doc_id", "piece").distinct().count() >= len(TEXTS) + 1
    assert toxicity.score(clashing, toxicity.ToxicityModel(None)).count() == n
    assert decontaminate.digest(decontaminate.decontaminate(clashing, bench)).count() == n


def test_empty_tables(spark, tokenizer):
    d = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert lm.score_documents(d, tokenizer).count() == 0
    assert quality.score(d, quality.train(d, labels)).count() == 0 and quality.keep_good(d, quality.train(d, labels)).count() == 0
    assert toxicity.score(d, toxicity.train(d, labels)).count() == 0
    assert decontaminate.digest(decontaminate.decontaminate(d, items)).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert decontaminate.digest(decontaminate.decontaminate(one, items)).first().n_hit == 0
    assert {r.score for r in quality.score(one, quality.train(one, labels)).collect()} == {0.5}
    assert jaccard.keep_one(d).count() == 0 and pii.replace_entities(d).count() == 0


def test_substrings_of_null_ids_and_repeated_rows(spark):
    long = " ".join(f"u{k}" for k in range(40))
    d = spark.createDataFrame([(None, long), (None, "short"), (7, long), (8, "v " + " ".join(f"v{k}" for k in range(50)))], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.dedup_substrings(d).collect())
    assert got == [(0, 1, 0), (0, 40, 40), (7, 40, 40), (8, 51, 0)]


def test_vectors_that_share_an_id_and_null_ids(spark):
    x = RNG.normal(size=(3, 8))
    near = lambda v: (v + RNG.normal(size=8) * 1e-3).tolist()
    rows = [(5, x[0].tolist(), 0), (5, x[1].tolist(), 0), (7, near(x[0]), 0), (8, near(x[1]), 0), (None, x[0].tolist(), 0), (9, x[2].tolist(), 0), (9, x[2].tolist(), 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x")).withColumn("shard", F.lit("y"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in neardup.near_duplicates(d).collect())
    assert got == [(0, 0, 0), (5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 1, 5), (9, 1, 9), (9, 1, 9)]


def test_dense_vectors_in_blocks_and_tiles(spark):
    base = RNG.normal(size=16)
    x = [(base + RNG.normal(size=16) * 0.01).tolist() for _ in range(120)]
    d = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = neardup.near_duplicates(d, shard=5).collect()
    assert {r.component_id for r in out} == {0} and np.mean([r.n_links for r in out]) >= 0.99 * 119


def test_large_groups_meet_across_tiles(spark, monkeypatch):
    for name, value in (("TILE", 4), ("ROWS", 64), ("UNIT_BYTES", 4096), ("PAIRS", 50)):
        monkeypatch.setattr(jaccard, name, value)
    vocab = [f"w{k}" for k in range(3000)]
    base = [RNG.choice(vocab, 150).tolist() for _ in range(4)]
    rows = []
    for b in base:
        for _ in range(25):
            w = list(b)
            for k in RNG.choice(150, int(RNG.integers(0, 9)), replace=False):
                w[k] = f"n{RNG.integers(10**9)}"
            rows.append((len(rows), " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up = [up[b] if u == up[a] else u for u in up] if up[b] < up[a] else [up[a] if u == up[b] else u for u in up]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similar_documents(d).collect()) == list(enumerate(up))


def test_toxicity_logits_equal_a_plain_recurrent_network():
    p = {k: v * np.float32(2) for k, v in toxicity._init(3).items()}
    model = toxicity.ToxicityModel(p)
    texts = [b"", b"one", b"A bad WORD here", b" ".join(b"t%d" % k for k in range(130))]

    def step(h, x, d):
        u = p[f"u{d}"].astype(float)
        g = 1 / (1 + np.exp(-(x[:16] + h @ u[:, :16])))
        z, r = g[:8], g[8:]
        return h + z * (np.tanh(x[16:] + (r * h) @ u[:, 16:]) - h)

    for t, got in zip(texts, model.logits(texts), strict=True):
        words, logits = t.lower().split(), []
        for at in range(0, max(1, len(words)), toxicity.STEP):
            own = words[at : at + toxicity.SPAN]
            if at and at + toxicity.SPAN - toxicity.STEP >= len(words):
                break
            if own:
                x = toxicity._inputs(p, toxicity.word_features(own)).astype(float)
                hs = {}
                for d, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
                    h = np.zeros(8)
                    for k in order:
                        h = step(h, x[k] @ p[f"w{d}"] + p[f"b{d}"], d)
                        hs[d, k] = h
                h = np.stack([np.concatenate([hs["f", k], hs["b", k]]) for k in range(len(own))])
                e = h @ p["a"]
                a = np.exp(e - e.max())
                logits.append((a / a.sum()) @ h @ p["o"] + p["c"][0])
        if logits:
            assert got == pytest.approx(max(logits), abs=1e-4), t


def test_training_windows_of_long_texts_cover_all_of_them():
    words = [f"w{k}" for k in range(20_000)]
    got = toxicity.spread_windows(" ".join(words).encode(), 80).split()
    assert got[0] == b"w0" and got[-1] == b"w19999" and len(got) <= 80 * toxicity.SPAN
    short = " ".join(words[:500]).encode()
    assert toxicity.spread_windows(short, 80) == short


def test_quality_scores_equal_a_plain_computation():
    rows = [np.unique(RNG.integers(0, 1 << 10, 30)) for _ in range(200)]
    labels = np.array([int(r.min() % 2) for r in rows])
    m = quality.fit(rows, labels, bits=10)
    train = [k for k in range(200) if k % 4]
    seen = np.ones((2, 1 << 10))
    for k in train:
        for f in rows[k]:
            seen[labels[k], f] += 1
    assert np.allclose(m.scale, np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum()))
    for text in (b"", b"Some words, 12 of them", b"x " * 30):
        _, f = quality.indicators([text], 10)
        x = m.scale[f]
        margin = (m.weight[f] @ x) / np.linalg.norm(x) + m.intercept if len(f) and np.linalg.norm(x) > 0 else m.intercept
        assert m.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-(m.slope * margin + m.shift))), rel=1e-9)
    # coordinate descent reaches the same objective as plain subgradient steps can't beat
    x, y = [np.append(m.scale[r] / np.linalg.norm(m.scale[r]), 1.0) for r in rows], labels * 2 - 1
    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0.0, 1 - y[k] * (w[rows[k]] @ x[k][:-1] + b)) for k in train)
    w, b = m.weight.copy(), m.intercept
    best = loss(w, b)
    for _ in range(20):
        assert loss(w + RNG.normal(size=len(w)) * 1e-3, b + RNG.normal() * 1e-3) > best - 1.0


def test_samples_are_bounded_in_rows(spark):
    d = spark.createDataFrame([(k % 10, f"t{k}") for k in range(500)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, quality int")
    got = sampling.labelled_sample(d, labels, "quality", 5, 0, 3).collect()
    assert 0 < len(got) <= 6 and len({r.doc_id for r in got}) == len(got)


def test_surrogates_touch_only_what_is_found(spark):
    texts = ["call 212-555-0188 or mail Bob.Ray@site.org; id 12.34", "plain words, no finds 2024-01-02", "token = abcdef123456 and 10.0.0.7!", "Mr Smith met Dr Jane Roe-Lee, Smith left."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_entities(d).collect()}
    pattern = regex.compile(pii.ANY.replace("\\p{Lu}", "\\p{Lu}"))
    for k, t in enumerate(texts):
        rest = pattern.split(t)
        if k == 1:
            assert got[k] == t
        if k in (0, 2):
            at = 0
            for piece in (x for x in rest if x):
                at = got[k].index(piece, at) + len(piece)
            assert all(m not in got[k] for m in pattern.findall(t))
    assert "Smith" not in got[3] and "Roe-Lee" not in got[3] and got[3].startswith("Mr ") and " met Dr " in got[3]


def test_folding_equals_running():
    for expr, want in (("1 | upper", "1"), ("x | upper", "1"), ("'a' ~ 1", "a1")):
        assert chat.compile_template("{{ " + expr + " }}")({"x": 1}).text == want
    render = chat.compile_template("{{ a + 1 }}")
    with pytest.raises(chat.TemplateError):
        render({"a": "text"})
    assert chat.compile_template("{% if no %}{{ 'a' + 1 }}{% endif %}ok")({}).text == "ok"


def test_a_cluster_needs_a_shared_folder():
    class Folder:
        isEmpty = staticmethod(lambda: True)

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Folder)}))})

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError):
        common.checkpoint_folder(Session)


def test_pipeline(spark, tmp_path, tokenizer):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "personal_data", "best_fit_packing"]
    good = lambda: " ".join(RNG.choice(["river", "garden", "letter", "music", "morning", "window", "paper", "summer"], 60)) + "."
    bad = lambda: " ".join(f"{w}!!" for w in RNG.choice(["BUY", "NOW", "CHEAP", "CLICK"], 40))
    item = " ".join(f"exam{k}" for k in range(20))
    rows = [(k, good() if k % 3 else bad(), "en", "s", "g") for k in range(300)]
    rows += [(1000, rows[1][1], "en", "s", "g"), (1001, item, "en", "s", "g"), (1002, good() + " Mail kim@corp.org now.", "en", "s", "g"), (None, good(), None, None, None), (1003, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, gone string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = d, {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == d.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {n: set(k) for n, k in kept.items()}
    assert not any(k is not None and k < 300 and k % 3 == 0 for k in ids["quality_classifier"]) and {k for k in range(300) if k % 3} <= ids["quality_classifier"]
    assert 1000 in ids["quality_classifier"] and 1000 not in ids["ngram_jaccard_join"] and 1 in ids["ngram_jaccard_join"]
    if 1001 in ids["ngram_jaccard_join"]:
        assert ids["ngram_jaccard_join"] - ids["benchmark_decontamination"] == {1001}
    assert "kim@corp.org" not in kept["personal_data"][1002] and None in ids["personal_data"]
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids["personal_data"]
    tok = packing.WordTokens(tokenizer)
    want = sorted((str(i), zlib.crc32(tok.ids((t or "").encode()) + bytes(4))) for i, t in kept["personal_data"].items())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in out) == want
