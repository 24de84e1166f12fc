"""Token counts that follow edits, from a segment tree of pre-tokens per document.

The leaves of a tree are runs of pieces of the text (see encode.Encoder): no pre-token
spans a border of two leaves, so counts of leaves add up. Each node holds the characters
and the tokens below it; a place is found by descent, an update touches one path. An
edit re-encodes the leaves that it touches and one more on each side: the outer borders
of that region keep both of their characters, so they stay borders.

A null text is empty. Rows are independent: repeated rows and null ids give a row each.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from quadlake.llm.encode import BYTE_BPE, Encoder, encoder
from quadlake.llm.tables import map_rows

LEAF_CHARS = 256
Edit = tuple[int, int, str]

# What the redaction of the query replaces.
REDACTIONS = [
    (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+", "<EMAIL>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"\+?\d[\d ().-]{7,30}\d", "<PHONE>"),
    (r"\b[0-9A-Fa-f]{32,128}\b", "<KEY>"),
]


@functools.cache
def _redaction(at: bool, digit: bool) -> tuple[re.Pattern, list[str]]:
    """The patterns that can match a text with or without an @ and a digit, as one."""
    possible = (at, digit, digit, True)
    found = [x for x, able in zip(REDACTIONS, possible, strict=True) if able]
    return re.compile("|".join(f"({p})" for p, _ in found)), [r for _, r in found]


_DIGIT = re.compile(r"\d")


def redactions(text: str) -> list[Edit]:
    """Edits (start, end, replacement) that mask addresses, numbers and keys."""
    pattern, masks = _redaction("@" in text, _DIGIT.search(text) is not None)
    return [(m.start(), m.end(), masks[m.lastindex - 1]) for m in pattern.finditer(text)]


def leaves_of(text: str, ids_of: Encoder, leaf_chars: int = LEAF_CHARS) -> tuple[list[int], list[int]]:
    """The characters and the tokens of the leaves of a text, which has one leaf at least."""
    pieces = ids_of.pieces(text)
    lengths = [len(p) for p in pieces]
    # Tokenizers that drop white space have pieces that do not add up to the text: one leaf.
    if sum(lengths) != len(text):
        return [len(text)], [len(ids_of.encode(text))]
    chars, tokens, size, count = [], [], 0, 0
    for length, n in zip(lengths, ids_of.piece_counts(pieces)):
        size += length
        count += n
        if size >= leaf_chars:
            chars.append(size)
            tokens.append(count)
            size = count = 0
    if size or not chars:
        chars.append(size)
        tokens.append(count)
    return chars, tokens


class TokenTree:
    """Sums of characters and tokens over the leaves of a text.

    Node k has the children 2 k and 2 k + 1; the leaves are the last half of the nodes.
    """

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def build(cls, chars: list[int], tokens: list[int]) -> TokenTree:
        n = 1 << max(0, (len(chars) - 1).bit_length())
        sums = np.zeros((2, 2 * n), np.int64)
        sums[0, n:n + len(chars)], sums[1, n:n + len(tokens)] = chars, tokens
        for level in range(n.bit_length() - 2, -1, -1):
            first = 1 << level
            sums[:, first:2 * first] = sums[:, 2 * first:4 * first:2] + sums[:, 2 * first + 1:4 * first:2]
        return cls(sums[0], sums[1])

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last used leaf, and the leaf's first character."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1] > 0:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def span(self, leaf: int) -> int:
        return int(self.chars[self.size + leaf])

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        more = (chars - self.chars[node], tokens - self.tokens[node])
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2


def build_tree(text: str, ids_of: Encoder) -> TokenTree:
    return TokenTree.build(*leaves_of(text, ids_of))


def apply(tree: TokenTree, text: str, edits: list[Edit], ids_of: Encoder) -> tuple[str, int]:
    """Apply edits (sorted, apart, places of the old text) to a text and its tree.

    Returns the new text and the number of characters that were encoded again.
    """
    again, shift, done, out = 0, 0, 0, []
    k = 0
    while k < len(edits):
        # Edits whose regions meet are one region.
        first, _ = tree.find(edits[k][0] + shift)
        last, at = tree.find(max(edits[k][0], edits[k][1] - 1) + shift)
        end = k + 1
        while end < len(edits):
            leaf, _ = tree.find(edits[end][0] + shift)
            if leaf > last + 2:
                break
            last, _ = tree.find(max(edits[end][0], edits[end][1] - 1) + shift)
            end += 1
        first = max(0, first - 1)
        last = min(tree.size - 1, last + 1)
        start = sum(int(tree.chars[n]) for n in _left_of(tree.size + first))
        length = sum(tree.span(i) for i in range(first, last + 1))
        old_start, old_end = start - shift, start - shift + length
        parts, at = [], old_start
        for a, b, replacement in edits[k:end]:
            parts += [text[at:a], replacement]
            at = b
        region = "".join([*parts, text[at:old_end]])
        out += [text[done:old_start], region]
        done = old_end
        again += len(region)
        chars, tokens = leaves_of(region, ids_of)
        room = last - first + 1
        # More leaves than there is room for end in one; fewer leave empty ones.
        for sums in (chars, tokens):
            sums[room - 1:] = [sum(sums[room - 1:])]
            sums += [0] * (room - len(sums))
        for leaf, (size, count) in enumerate(zip(chars, tokens), first):
            tree.set(leaf, size, count)
        shift += len(region) - length
        k = end
    return "".join([*out, text[done:]]), again


def _left_of(node: int) -> Iterator[int]:
    while node > 1:
        if node % 2:
            yield node - 1
        node //= 2


TREES = "doc_id long, text string, tree_chars array<long>, tree_tokens array<long>, n_tokens long"


def build_trees(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """The tree of each document, as the arrays of its nodes, beside its text."""
    def build(rows: Iterator[tuple]) -> Iterable[tuple]:
        ids_of = encoder(tokenizer)
        for doc_id, text in rows:
            tree = build_tree(text or "", ids_of)
            yield doc_id, text or "", tree.chars, tree.tokens, tree.n_tokens

    return map_rows(docs.select("doc_id", "text"), build, TREES, 256)


COUNTS = ("doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, "
          "chars_encoded_again long, n_leaves long")


def count_edited(trees: DataFrame, edits_of: Callable[[str], list[Edit]] = redactions,
                 tokenizer: str = BYTE_BPE) -> DataFrame:
    """Token counts of documents before and after edits, from their trees."""
    def count(rows: Iterator[tuple]) -> Iterable[tuple]:
        ids_of = encoder(tokenizer)
        for doc_id, text, chars, tokens, n_tokens in rows:
            tree = TokenTree(np.array(chars), np.array(tokens))
            edits = edits_of(text)
            new, again = apply(tree, text, edits, ids_of)
            yield doc_id, n_tokens, len(edits), tree.n_tokens, len(new), again, int(np.count_nonzero(tree.chars[tree.size:]))

    return map_rows(trees, count, COUNTS)
