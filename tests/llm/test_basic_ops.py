"""Packing, chat formatting, decontamination and quality against plain versions, with edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from tessera.llm import chat, decontaminate, packing, quality

EDGES = [None, "", "  \n\t", "a", "A b\x0bc", "É" * 50, "x " * 5000, "<|endoftext|>", "don't STOP'S été, 12a3 İ! x̧́ a\x1cb a\xa0b 😀"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return str(P.path("word_bpe_49k.json"))


def test_word_tokens_equal_the_tokenizer(tokenizer):
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(tokenizer), packing.WordTokens(tokenizer)
    for s in EDGES:
        s = s or ""
        assert np.frombuffer(own.ids(s.encode()), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


def test_packing_keeps_every_token(spark, tokenizer):
    rows = [(i, t, "x") for i, t in enumerate(EDGES)] + [(None, "no id", "x"), (3, "a", "x"), (3, "a", "x")]
    out = packing.pack_documents(frame(spark, rows, "doc_id long, text string, piece string"), tokenizer, capacity=64, open_bins=4).collect()
    own = packing.WordTokens(tokenizer)
    want = sorted((str(i), k, zlib.crc32(ids[256 * k : 256 * k + 256])) for i, t, _ in rows for ids in [own.ids((t or "").encode()) + bytes(4)] for k in range(-(-len(ids) // 256)))
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(frame(spark, [], "doc_id long, text string"), tokenizer).count() == 0


def test_open_bins_are_best_fit_and_bounded():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 9, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (5, 7, 8, 2, 5)] == [(0, 0), (1, 0), (2, 0), (2, 8), (0, 5)]  # the third closes the bin of 7


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\<|end|>", "<|text|><<|end|>", "<", "", None, "<<SYS>>\\\\<|turn|>", "a<s"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)] + [(2, None, None, None), (None, 5, "system", "s"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b")]
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(frame(spark, rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        turns = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        said = "".join(t for _, _, r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), turns, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digest(chat.format_conversations(frame(spark, [], "conv_id long, turn long, role string, text string"))).count() == 0


def test_template_language():
    t = "{% set n = 'a' ~ 'b' %}{% if 1 == 2 %}no{% elif who == 'x' and not (who in 'yz') %}X{{ n | upper }}{% else %}-{% endif %}{% for m in ms %}[{% generation %}{{ m['t'] }}{% endgeneration %}]{% endfor %}"
    tree = chat.fold(chat.parse(t))
    assert tree[0] == chat.Set("n", chat.Const("ab")) and len(tree[1].cases) == 1
    r = chat.compile_template(t)({"who": "x", "ms": [{"t": "1"}, {"t": "22"}]})
    assert (r.text, r.spans) == ("XAB[1][22]", [[4, 5], [7, 9]])
    for bad in ("{{ a.__class__ }}", "{{ a._b }}", "{{ f(1) }}", "{% if x %}", "{% endif %}", "{{ a | eval }}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_decontamination_against_plain_scan(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abÉ7"), 2))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((1, 3, 13, 14, 30, 0, 20))] + [(9, None), (None, "x y"), (10, "same Words here"), (11, "same-words HERE!")]
    docs = [(k, " ".join(word() for _ in range(60)) + ", " + (items[int(rng.integers(7))][1] or "").upper() + " - tail " + word()) for k in range(30)]
    docs += [(100 + k, t) for k, t in enumerate(EDGES)] + [(None, "Same words\nhere"), (7, "dup"), (7, "dup")]
    d, b = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for k, s in items:
            v = words(s)
            n = min(13, len(v))
            for a in range(len(v) - n + 1) if v and k is not None else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit.update(range(p, p + n))
                        own.add(str(k))
        want.append((str(i), len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = [(str(r[0]), *r[1:]) for r in decontaminate.digest(decontaminate.decontaminate(d, b)).collect()]
    assert sorted(got) == sorted(want)
    split = decontaminate.digest(decontaminate.decontaminate(d, b, max_broadcast_bytes=60)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in split if r[0] != 7) == sorted(x for x in want if x[0] != "7")
    for r in decontaminate.decontaminate(d, b).where("doc_id < 30").collect():
        text = docs[r.doc_id][1]
        assert [words(text[s.start : s.end]) for s in r.spans] == [words(text)[x.first : x.last] for x in r.runs]


def test_decontamination_judges_each_row_alone(spark):
    items = [(k, " ".join(f"i{k}w{n}" for n in range(13))) for k in range(20)] + [(None, " ".join(f"null{n}" for n in range(13)))]
    clean = " ".join(f"c{n}" for n in range(40))
    rows = [(None, items[0][1], "a"), (None, clean, "b"), (None, f"{items[1][1]} {clean} {items[2][1]}", "c"), (7, items[3][1], "d"), (7, clean, "e"), (8, clean, "f"), (9, items[-1][1], "g"), (None, clean, "h")]
    d, b = frame(spark, rows, "doc_id long, text string, name string"), frame(spark, items, "item_id long, text string")
    want = sorted((str(i), len(t.split()), hits, len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), hits > 0) for (i, t, _), hits, own in zip(rows, (13, 0, 26, 13, 0, 0, 13, 0), (["0"], [], ["1", "2"], ["3"], [], [], [], []), strict=True))
    for limit in (64 << 20, 200):
        got = decontaminate.digest(decontaminate.decontaminate(d, b, max_broadcast_bytes=limit)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want, limit
        assert sorted(r.name for r in decontaminate.reject_contaminated(d, b, max_broadcast_bytes=limit).collect()) == list("befh"), limit


def test_quality(spark):
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "and"], 30)) + "."
    bad = lambda: " ".join(w + "!!" for w in rng.choice(["the", "cat", "buy", "now"], 30)).upper()
    docs = [(k, good() if k % 3 else bad()) for k in range(300)] + [(1000 + k, t) for k, t in enumerate(EDGES)] + [(None, "x"), (1, "x"), (1, "x")]
    labels = [(k, int(k % 3 > 0)) for k in range(300)] + [(None, 1), (5, None), (6, 0)]
    d, l = frame(spark, docs, "doc_id long, text string"), frame(spark, labels, "doc_id long, quality int")  # noqa: E741
    out = quality.score(d, quality.train(d, l)).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 300]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    none = quality.train(d, l.where("quality = 1"))
    assert {r.score for r in quality.score(d, none).collect()} == {0.5}
