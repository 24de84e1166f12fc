"""Texts with white space beyond ASCII: exact ids, and edits that re-encode only what they touch."""

import random

import public_tokenizers
import pytest

from quadlake.llm import encode
from quadlake.llm.encode import BYTE_BPE, WORD_BPE, Encoder
from quadlake.llm.token_counts import apply, build_tree

ODD = ["\xa0", "\x1c", "\x1f", "\x85", "\u1680", "\u2003", "\u2009", "\u2028", "\u202f", "\u3000"]
PARTS = [*ODD, *ODD, " ", " ", "  ", "\n", "\t", "\r\n", "a", "Wort", "dé", "12", "!", "'s", "_", "?!", "中", "​", "\U0001f600", "<"]


@pytest.fixture(scope="module", params=[BYTE_BPE, WORD_BPE])
def ids_of(request):
    return Encoder(public_tokenizers.path(request.param))


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(1, longest))) for _ in range(n)]


def test_ids_are_those_of_the_library(ids_of):
    for text in texts(1, 4000, 30):
        assert ids_of.encode(text).tolist() == ids_of._direct(text), repr(text)


def test_slices_of_long_texts(ids_of, monkeypatch):
    monkeypatch.setattr(encode, "SLICE_CHARS", 50)
    for text in texts(2, 300, 400):
        assert ids_of.encode(text).tolist() == ids_of._direct(text), repr(text)


def test_edits_stay_local():
    ids_of = Encoder(public_tokenizers.path(BYTE_BPE))
    rng = random.Random(3)
    for text in texts(4, 150, 2500):
        tree = build_tree(text, ids_of)
        assert tree.n_tokens == len(ids_of._direct(text))
        for _ in range(3):
            places = sorted(rng.sample(range(len(text) + 1), min(6, len(text) + 1)))
            edits = [(a, b, rng.choice(["", "\xa0", " ", "x", "\n "])) for a, b in zip(places[::2], places[1::2])]
            text, _ = apply(tree, text, edits, ids_of)
            assert tree.n_tokens == len(ids_of._direct(text)), (text, edits)
    words = "eins zwei\xa0drei, vier " * 4000
    tree = build_tree(words, ids_of)
    new, again = apply(tree, words, [(40000, 40004, "\xa0")], ids_of)
    assert tree.n_tokens == len(ids_of._direct(new)) and again < 2000
