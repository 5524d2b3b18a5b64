"""What op2's CPU time went to (finding of round 3): words looked up for each mark they end in, and one by one; results stay as they were."""

import random

import numpy as np
import pyarrow as pa
from tessera.llm import common, lm, packing
from tessera.llm.queries import tokenizer_path

PARTS = ["a", "B", "é", "É", "ß", "İ", "ı", "Σ", "'s", "don't", ".", "!?", "\x0b", "\x1c", "\x85", " ", " ", "<|", "<|endoftext|>", "12", "-", "abc", "ſ", "K", "é", "中", "\U0001f600", "$", "#", "&", "\t", "\n", " ", "  "]


def odd_texts(n: int = 1500) -> list[str]:
    rng = random.Random(3)
    return ["", " ", "  \n", ".", " x ", *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60))) for _ in range(n))]


def test_words_are_those_of_bytes():
    texts = odd_texts()
    words, n = lm._words(pa.array(texts))
    own = [t.encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in own]
    assert common.byte_strings(words) == [w for each in own for w in each]
    assert common.byte_strings(words.slice(7, 5)) == [w for each in own for w in each][7:12]


def test_ids_of_words_are_the_tokenizers_and_marks_cost_no_look_up():
    tok = packing.WordTokens(tokenizer_path())
    words = sorted({w for t in odd_texts() for w in t.encode().lower().split()})
    ids, n = tok.ids_of(pa.array(words, pa.binary()).cast(pa.string()))
    cut = np.cumsum(n)[:-1]
    for w, own in zip(words, np.split(ids, cut), strict=True):
        assert own.tolist() == tok.tok.encode(w.decode(), add_special_tokens=False).ids, w
    plain = packing.WordTokens(tokenizer_path())
    ids, n = plain.ids_of(pa.array(["river" + m for m in ("", ".", ",", "!", "!!", "?", "...")]))
    assert len(plain.cores) == 1 and not plain.words and len(n) == 7


def test_hashes_of_strings_follow_from_their_bytes():
    words = ["", "\0", "\0\0", "a", "a\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "habcdefg", "x" * 256, "x" * 257, "x" * 255 + "y", "é", "中"]
    words += [f"w{k}" for k in range(3000)]
    h = common.string_hashes(pa.array(words))
    assert len(set(h.tolist())) == len(words)
    order = np.random.default_rng(1).permutation(len(words))
    assert (common.string_hashes(pa.array(["before", *(words[k] for k in order)]).slice(1)) == h[order]).all()


def test_scoring_takes_one_row_of_numbers_for_each_place():
    """States and queries are looked up, not states, queries, keys, values and a one; windows that read on into the next text give the same."""
    rng = np.random.default_rng(2)
    first, second = lm.tables(rng.integers(0, 9, (33, 32)), 4)
    m = lm.Model(rng.integers(0, 32, 60), np.zeros(60, np.float32), first, second, {k: v * np.float32(3) for k, v in lm.init_weights(32, 4).items()})
    assert sum(t.shape[1] for t in m.fused() if len(t) == 33) == 2 * lm.WIDTH + 4
    texts = [rng.integers(0, 60, n) for n in (1, 5, lm.SPAN, 3, lm.SPAN + 1, 200, 2)]
    together = lm.score_texts(m, texts)
    assert np.allclose(together, [lm.score_texts(m, [t])[0] for t in texts], rtol=1e-6)
