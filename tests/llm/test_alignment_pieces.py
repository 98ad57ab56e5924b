"""Pieces of texts that the alignment encodes once, against encoding every text whole."""

import random

import public_tokenizers
import pytest

from cuelattice.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
# All white space, its neighbours, characters that share its first bytes, and characters of which B loses or changes some.
BLANKS = "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0 ᠎    ​    ⁠　﻿"
ODD = BLANKS + "\x00\x7f\x80\xa1\xbf\xe9▁–“€、日本ͅê①ﬁ٣\xb2's"


def whole(tok, texts):
    return [tok.a.encode(" " + t, add_special_tokens=False).ids if t else [] for t in texts], [tok.b.encode(t) if t else [] for t in texts]


def test_every_neighbour_of_a_space():
    tok = token_alignment.Tokenizers(A, B)
    assert tok.cuts
    chars = ODD + "".join(map(chr, range(33, 0x3100, 7))) + "".join(map(chr, range(0xFB00, 0x1F700, 997)))
    texts = [f"ab{x} {y}cd ef" for c in chars for x, y in ((c, ""), ("", c), (c, c))]
    got = tok.encode(texts)
    assert tuple(x.to_pylist() for x in got) == whole(tok, texts)


@pytest.mark.parametrize("pieces, size", [(1 << 18, 1 << 24), (40, 1 << 24), (1 << 18, 60), (0, 0)])
def test_random_texts_and_small_bounds(pieces, size):
    rng = random.Random(pieces + size)
    tok = token_alignment.Tokenizers(A, B, kept_pieces=pieces, kept_bytes=size)
    words = ["the", "of", "don't", "'s", "a1b2", "12345", "!!", "</s>", "<|endoftext|>", "x" * 90, "日本語", "", " ", "  ", "\n", " \n ", *ODD]
    for _ in range(12):
        texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", " ", "\n", "  "]) for _ in range(rng.randrange(12))) for _ in range(60)] + ["", " ", "a ", "  b"]
        got = tok.encode(texts)
        assert tuple(x.to_pylist() for x in got) == whole(tok, texts)
        assert len(tok.slot) <= pieces and tok.size.sum() <= size
        assert len(tok.slot) == len(tok.sound) == len(tok.size) == len(tok.seen) == len(tok.ids[0]) == len(tok.ids[1])
    assert [x.to_pylist() for x in tok.encode([])] == [[], []] and [x.to_pylist() for x in tok.encode(["", ""])] == [[[], []], [[], []]]


def test_without_cuts():
    tok = token_alignment.Tokenizers(A, B)
    tok.cuts = False
    texts = ["one two", "", "a▁b c", " "]
    assert tuple(x.to_pylist() for x in tok.encode(texts)) == whole(tok, texts)


def test_a_word_is_encoded_once():
    class Counted:
        """Counts the characters given to a tokenizer."""

        def __init__(self, own):
            self.own, self.n = own, 0

        def encode_batch_fast(self, texts, **kw):
            self.n += sum(map(len, texts))
            return self.own.encode_batch_fast(texts, **kw)

        def encode(self, texts, **kw):
            self.n += sum(map(len, texts))
            return self.own.encode(texts, **kw)

    tok = token_alignment.Tokenizers(A, B)
    a, b = tok.a, tok.b
    tok.a, tok.b = Counted(a), Counted(b)
    rng = random.Random(7)
    words = [f"word{k}" for k in range(200)]
    for _ in range(3):
        texts = [" ".join(rng.choices(words, k=100)) for _ in range(100)]
        got = token_alignment.aligned(texts, tok)
        assert got["n_a"].to_pylist() == [len(a.encode(" " + t).ids) for t in texts] and got["n_b"].to_pylist() == [len(b.encode(t)) for t in texts]
    # Three times 10,000 words of 200: each once as a piece, not once for each place.
    assert tok.a.n <= 200 * 10 and tok.b.n <= 200 * 10
