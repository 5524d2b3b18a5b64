"""SentencePiece encoding, spelling variants and conversation repair against the library, brute force and hand cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import pieces, repair, spelling
from tessera.llm.queries import tokenizer_path

MODEL = "piece_bpe_32k.model"
SIGNS = ["a", "b", " ", "  ", "▁", "é", "日", "\n", "\t", "①", "the", "ing", "\U0001f600", "1", "23", "‍", "Ⅷ", "ﬀ", "\0", "´", "ｶﾞ", "</s>", "<0x41>"]


def samples(n=300):
    rng = random.Random(5)
    return ["", " ", "   ", "▁▁x ▁", "aaaa" * 3000, "no-space" * 400] + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def library_spans(processor, text):
    at = np.cumsum([0] + [len(c.encode()) for c in text])
    found = [(p.begin, p.end) for p in processor.encode(text, return_type="proto").pieces]
    return found, [(at[x], at[y]) for x, y in found if y < len(at)]


# --- op11


def test_pieces_equal_the_library():
    import sentencepiece

    path = tokenizer_path(MODEL)
    own, lib = pieces.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in samples():
        ids, starts, ends = own.encode(text.encode())
        want = lib.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want
        assert own.decode(ids) == lib.decode(want)
        assert list(zip(starts[1:-1].tolist(), ends[1:-1].tolist(), strict=True)) in library_spans(lib, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("strip", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_compiled_maps_equal_the_library(rule, strip, dummy):
    """The same pieces behind other compiled maps and switches."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(tokenizer_path(MODEL), "rb") as f:
        model = schema.ModelProto.FromString(f.read())
    other = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=strip, escape_whitespaces=True)
    model.normalizer_spec.CopyFrom(schema.ModelProto.FromString(other.serialized_model_proto()).normalizer_spec)
    raw = model.SerializeToString()
    own, lib = pieces.Encoder.of(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in samples(120):
        ids, starts, ends = own.encode(text.encode())
        want = lib.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want
        assert own.decode(ids) == lib.decode(want)
        assert list(zip(starts[1:-1].tolist(), ends[1:-1].tolist(), strict=True)) in library_spans(lib, text)


def test_bytes_that_are_no_text():
    own = pieces.Encoder(tokenizer_path(MODEL))
    ids, starts, ends = own.encode(b"a\xffb\xe2\x96c")
    assert own.decode(ids) == "a�b��c"
    assert ends[-2] == 6 and starts[1] == 0
    byte = {b: i for i, b in own.byte_of.items()}
    assert own.decode(np.array([1, byte[0xE6], byte[0x97], byte[0xA5], byte[0xE6], 2])) == "日�"


def test_pieces_on_rows(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    texts = [None, "", "a b", "a b", "日本①", "word " * 50_000]
    rows = [(k if k != 3 else None, t, 1, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    path = tokenizer_path(MODEL)
    encoded = pieces.encode_documents(docs, path)
    got = pieces.digest(pieces.decode_documents(encoded, path)).collect()
    want = []
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spans = encoded.where("doc_id = 4").first()
    assert [("日本①".encode()[a:b]) for a, b in zip(spans.starts, spans.ends, strict=True)][2:-1] == ["日".encode(), "本".encode(), b"", b"", "①".encode()]
    assert pieces.encode_documents(docs.limit(0), path).count() == 0


# --- op12


def plain_variants(rows):
    counts = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            counts[r] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    near, cuts = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            rest = w[:k] + w[k + 1 :]
            cuts[k, rest].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in cuts.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def made_documents():
    rng = random.Random(11)
    letters = "etaoinshrdluéçÉÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(60)] + ["eeeeeeeeeeeeee", "eeeeeeeeeeeee", "eeeeeeeeeetee", "ttttttttttttttt" * 4, "ttttttttttttttt" * 4 + "t", "x" * 3000, "x" * 2999 + "y"]
    rows = []
    for k in range(300):
        words = []
        for _ in range(rng.randint(0, 80)):
            w = base[min(int(rng.expovariate(0.08)), len(base) - 1)]
            if rng.random() < 0.15:
                p = rng.randrange(len(w))
                w = w[:p] + rng.choice(["", rng.choice(letters), w[p] + "a"]) + w[p + 1 :]
            words.append(w.upper() if rng.random() < 0.05 and w.isascii() else w)
        rows.append((k, " ".join(words)))
    return rows + [(None, "alphabet alphabet alphabats"), (None, None), (3, ""), (3, rows[3][1]), (7, "Zeichen123zeichen, zeichen")]


@pytest.mark.parametrize("shard", [7, 40, spelling.SHARD])
def test_variants_equal_brute_force(spark, shard):
    rows = made_documents()
    want = plain_variants(rows)
    assert sum(v[3] for v in want.values()) > 300 and any(v[1] != v[0] and v[0] for v in want.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("word"), F.lit(2).alias("n"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs, shard=shard).collect()}
    assert got == want


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_in_every_shard_once():
    """Counts beyond the cap hide differences from the upper trie; no pair is lost there, and none comes twice."""
    rng = random.Random(2)
    words = list({"".join(rng.choice("et") for _ in range(rng.randint(14, 17))) for _ in range(400)})
    latin = [w.encode() for w in words]
    codes = Counter(spelling._code(spelling.vectors(latin)).tolist())
    upper = spelling.Upper(dict(codes), 10)
    counts = np.minimum(spelling.vectors(latin)[:, : spelling.ROUTE], spelling.CAP)
    home = {w: k for k, own in upper.reach(counts, exact=True) for w in own.tolist()}
    assert len(home) == len(words)
    found = Counter()
    for k, own in upper.reach(counts):
        mine = [latin[i] for i, h in home.items() if h == k]
        trie = spelling.Trie(mine, np.ones(len(mine), np.int64))
        asked = [latin[i] for i in own.tolist()]
        near, _ = trie.search(asked, np.ones(len(asked), np.int64))
        for w, n in [*zip(asked, near.tolist(), strict=True), *zip(trie.words, trie.near.tolist(), strict=True)]:
            found[w] += n
    assert {w: found[w] for w in latin} == {w: sum(spelling.plainly_near(w, x) for x in latin) for w in latin}


# --- op13

NEXT = {"0": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}


def plain_repair(rows):
    """Cost and audit by trying every string of edits; rows are (initial, delete, cut short)."""
    best = [(10**9, "")]

    def go(i, state, cost, audit, inserted):
        if cost > best[0][0]:
            return
        if inserted < 3:
            for t in "ua":
                if t in NEXT[state]:
                    go(i, NEXT[state][t], cost + 2, audit + "I", inserted + 1)
        if i == len(rows):
            if state in "0A":
                best[0] = min(best[0], (cost, audit))
            return
        initial, delete, cut = rows[i]
        go(i + 1, state, cost + 3, audit + "D", 0)
        if not delete:
            for t in {initial, "u", "a"} & NEXT[state].keys():
                go(i + 1, NEXT[state][t], cost + cut + (0 if t == initial else 2), audit + ("K" if t == initial else "R"), 0)

    go(0, "0", 0, "", 0)
    return best[0]


NAMES = {"s": "system", "u": "user", "a": "assistant", "t": "tool", "": ""}


@pytest.mark.parametrize("look", [1, 32])
def test_parser_equals_every_string_of_edits(look):
    rng = random.Random(look)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 6))]
        parser, edits = repair.Repairer(), []
        parser.look = look
        for initial, delete, cut in rows:
            parser.take(NAMES[initial], "x", delete, cut)
            edits += parser.settled()
        cost, rest = parser.finish()
        assert (cost, "".join(e.action for e in edits + rest)) == plain_repair(rows)


def test_long_conversations_are_passed_on():
    """Edits leave while rows come, also after a long stretch of rows that must go."""
    parser, held = repair.Repairer(), []
    for k in range(20_000):
        parser.take("user" if k % 2 == 0 else "assistant", "x", 5_000 < k < 9_000, False)
        parser.settled()
        held.append(parser.heads[next(iter(parser.heads))][1].depth - parser.done.depth)
    assert max(held[:5_000]) < 100 and max(held[12_000:]) < 100


def plain_conversations(rows):
    after = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        after[c] += [] if h == 0 else [(t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (2 if h == 3 else 1)
    out = []
    for c, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, faults = set(), [], Counter()
        for t, role, text in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))  # noqa: B905
        cost, audit = plain_repair(judged)
        body, k = [], 0
        for e in audit:
            nth = len(body) - bool(body and body[0][0][:1] == "s")
            if e != "I":
                k += 1
            if e != "D":
                body.append((own[k - 1][1] if e == "K" else "assistant" if nth % 2 else "user", "" if e == "I" else own[k - 1][2]))
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in body).encode()).hexdigest()))
    return out


def test_repair_on_rows(spark):
    rng = random.Random(8)
    texts = ["Yes.", "No", " \n", "", None, "Well?", "Ok!  ", "a ", "Yes."]
    rows = [(rng.randint(0, 60), rng.choice([None, 0, 1, 2, 3, 4, 7]), rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rng.choice(texts)) for _ in range(240)]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (-1, None, None, None)]
    # ids whose only row is lost
    lost = [c for c in range(1000, 1200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost
    rows += [(c, 0, "user", "Hi.") for c in lost]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit("x").alias("fault"), F.lit(1).alias("lost"), F.lit(2).alias("kind"))
    edits = repair.repair(repair.find_faults(repair.damage(table.repartition(5))))
    assert sorted(map(tuple, repair.digest(edits).collect()), key=str) == sorted(plain_conversations(rows), key=str)
    assert {r.action for r in edits.select("action").distinct().collect()} == {"K", "R", "D", "I", None}
    gone = repair.digest(edits).where(F.col("conv_id") == lost[0]).first()
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.digest(repair.repair(repair.find_faults(repair.damage(table.limit(0))))).count() == 0


# --- op9: forms of personal data


def pii_forms():
    """(kind, form) of data that is written in many ways, made from the formats and not from the patterns."""
    rng = random.Random(9)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    h = lambda: f"{rng.randrange(1, 65536):x}"
    out = []
    for k in range(20):
        out += [("ip6", ":".join(h() for _ in range(8))), ("ip6", f"{h()}:{h()}::{h()}"), ("ip6", f"2001:db8::{h()}"), ("ip6", ":".join(f"{rng.randrange(65536):04X}" for _ in range(8)))]
        out += [("mail", f"{w(4)}.{w(5)}@{w(6)}.org"), ("mail", f"{w(3).capitalize()}_{d(2)}@{w(4)}-{w(3)}.{w(5)}.com")]
        out += [("phone", f"+44 20 {d(4)} {d(4)}"), ("phone", f"0044 20 {d(4)} {d(4)}"), ("phone", f"004420{d(8)}"), ("phone", f"({rng.randrange(200, 999)}) {d(3)}-{d(4)}"), ("phone", f"+1-{rng.randrange(200, 999)}-{d(3)}-{d(4)}")]
        out += [("ssn", f"{d(3)}-{d(2)}-{d(4)}"), ("card", f"4{d(3)} {d(4)} {d(4)} {d(4)}"), ("card", f"37{d(2)}-{d(6)}-{d(5)}"), ("login", f"https://{w(5)}:{w(4)}{d(3)}@{w(6)}.net/x")]
    return out


def test_forms_keep_their_classes(spark):
    from tessera.llm import pii

    forms = pii_forms()
    assert len(forms) >= 300
    d = spark.createDataFrame([(k, f"see {f} now") for k, (_, f) in enumerate(forms)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in pii.replace_entities(d, count="n").collect()}
    classes = lambda x: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", x)))
    for k, (kind, f) in enumerate(forms):
        text, n = got[k]
        new = text.removeprefix("see ").removesuffix(" now")
        assert n == 1 and new != f, (kind, f, text)
        if kind == "ip6":
            # hexadecimal digits for hexadecimal digits, and the same groups
            assert re.sub("[0-9a-fA-F]", "x", new) == re.sub("[0-9a-fA-F]", "x", f) and re.fullmatch("[0-9a-fA-F:]+", new) and (f == f.lower()) == (new == new.lower()), (f, new)
        elif kind == "login":
            assert new.split(":")[1] == f.split(":")[1] and new.split("@")[1] == f.split("@")[1] and new.split("@")[0] != f.split("@")[0] and classes(new) == classes(f)
        else:
            assert classes(new) == classes(f), (kind, f, new)
        if f.startswith(("+44", "0044")):
            assert new.startswith(f[: 4 if f[0] == "0" else 3])


def test_names_in_other_forms(spark):
    from tessera.llm import pii

    texts = {
        1: "Mr McDonald came. McDonald left.",
        2: "Ms O'Brien and Prof. D’Angelo sat.",
        3: "Mrs SMITH signed; Mr Smith did not, SMITH said.",
        4: "Ms. de la Cruz, then Dr Ana de la Cruz.",
        5: "Herr von der Heide und Frau Müller-Lüdenscheidt gingen.",
        6: "MR SMITH is left alone, and the Dr is in.",
        7: "::1 and a::1 and fe80::1 at 10:20:30",
    }
    got = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert re.fullmatch(r"Mr (\w+) came\. \1 left\.", got[1]) and "McDonald" not in got[1]
    assert "Brien" not in got[2] and "Angelo" not in got[2] and re.fullmatch(r"Ms \w+ and Prof\. \w+ sat\.", got[2])
    caps = re.fullmatch(r"Mrs ([A-Z]+) signed; Mr ([A-Z][a-z]+) did not, \1 said\.", got[3])
    assert caps and caps[1] == caps[2].upper() != "SMITH"
    cruz = re.fullmatch(r"Ms\. de la (\w+), then Dr (\w+) de la \1\.", got[4])
    assert cruz and cruz[1] != "Cruz" and cruz[2] != "Ana"
    assert re.fullmatch(r"Herr von der (\w+) und Frau [\w-]+ gingen\.", got[5]) and "Heide" not in got[5] and "Lüdenscheidt" not in got[5]
    assert got[6] == texts[6]
    assert "a::1" not in got[7] and "fe80::1" not in got[7] and got[7].endswith(" at 10:20:30")


def test_short_addresses_do_not_run_out(spark):
    from tessera.llm import pii

    rows = [(k, f"at {k % 10}::{k // 10 % 10} and {'abcdef'[k % 6]}::{k % 10} end") for k in range(160)]
    got = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    made = {x for r in got for x in re.findall(r"\S*::\S*", r.text)}
    was = {x for _, t in rows for x in re.findall(r"\S*::\S*", t)}
    assert len(made) == len(was) and not made & was


# --- op2: scores follow from the table


def test_scores_do_not_depend_on_partitions(spark):
    from tessera.llm import lm

    rng = random.Random(12)
    words = ["red", "green", "blue", "house", "tree", "river", "stone", "cloud", "walks", "sleeps", "under", "over", "the", "a"]
    rows = [(k, " ".join(rng.choice(words[: 4 + k % 11]) for _ in range(rng.randint(1, 120)))) for k in range(150)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, None), (200, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in (1, 4, 16):
        out = lm.score_documents(docs.repartition(parts), tokenizer_path(), groups=4, members=8, every=4).select("doc_id", "n_tokens", "score", "base_score").collect()
        found.append(sorted(map(tuple, out), key=str))
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-6)


def test_every_token_of_training_is_learnt_once():
    """Over the rounds, the windows that are learnt hold each token once, as the class it is and after the class it follows."""
    from tessera.llm import lm

    rng = np.random.default_rng(4)
    lengths = [1, 2, lm.SPAN - 1, lm.SPAN, lm.SPAN + 1, 2 * lm.SPAN, 2 * lm.SPAN + 1, 700]
    texts = [rng.integers(0, 50, n) for n in lengths]
    m = lm.Model(np.arange(50) % 12, None, None, None, None)
    m.second = np.zeros((13, 4, 3))
    _, y, x = lm.laid_out(m, texts)
    for rounds in (1, 2, 3):
        learnt, buckets = [], []
        for number in range(rounds):
            bucket, rows = lm._dealt_windows(texts, x, y, number, rounds, 5)
            prev, group, real = lm._unpacked_windows(rows, 3)
            learnt += list(zip(prev[real].tolist(), group[real].tolist(), strict=True))
            buckets += bucket.tolist()
        assert sorted(learnt) == sorted(zip(x.tolist(), (y // 3).tolist(), strict=True))
        assert len(buckets) == sum(-(-n // lm.SPAN) for n in lengths) and set(buckets) <= set(range(5))
    assert lm.score_documents.__defaults__[-2] == 1  # every window, unless a caller wants fewer


def test_training_follows_the_plain_gradient():
    """The first step of Adam has the sign of the loss's gradient, here from differences of the plain forward pass."""
    from tessera.llm import lm

    rng = np.random.default_rng(5)
    w = {k: v.astype(np.float64) for k, v in lm.init_weights(6, 3, width=4, span=5).items()}
    first = np.log(rng.dirichlet(np.ones(3), 7))
    x, g = rng.integers(0, 7, (8, 5)), rng.integers(0, 3, (8, 5))
    real = np.arange(5) < rng.integers(1, 6, 8)[:, None]

    def loss(at):
        m = lm.Model(None, None, first, np.zeros((7, 3, 2)), at)
        return -lm.group_log_probs(m, x, g)[real].mean()

    after = lm.train_steps(w, first, x, g, real, 1, size=8)
    seen = 0
    for name, v in w.items():
        for place in np.ndindex(v.shape):
            up, down = ({**w, name: v.copy()} for _ in range(2))
            up[name][place] += 1e-5
            down[name][place] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            if abs(slope) > 1e-4:
                assert np.sign(w[name][place] - after[name][place]) == np.sign(slope), (name, place)
                seen += 1
    assert seen > 60


def test_idle_workers_hold_few_words(spark):
    """Workers are used in turn, so what each holds after its task counts for all of them."""
    import pyarrow as pa
    from tessera.llm import packing

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    docs = spark.createDataFrame([(k, " ".join(word() for _ in range(14_000))) for k in range(10)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in packing.pieces(docs, tokenizer_path()).where("piece = 0").collect()}
    assert len(got) == 10

    def held(batches):
        from tessera.llm import packing

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max((max(len(t.words), len(t.pieces)) for t in packing._loaded.values()), default=0)], pa.int64())], names=["n"])

    most = max(r.n for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect())
    assert most <= 100_000
