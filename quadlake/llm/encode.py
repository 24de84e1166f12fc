"""Exact token ids of whole texts, with the pre-tokens seen so far kept per worker.

A text is cut before each run of ASCII white space that follows characters that are no white
space of any kind, and between letters or digits and ASCII punctuation. No pre-token spans such
a place, so the pieces can be encoded one by one and repeated pieces are looked up. New pieces go to the tokenizers library in one string, held
apart by a special token, which the library splits off before anything else.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

SPACE = " \t\n\r\x0b\x0c"
# White space that is not ASCII, or on which the regular-expression engines differ: it
# may take part in a run that ASCII white space continues.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
# ASCII punctuation but the apostrophe, which may belong to a contraction.
_MARK = r"!-&(-/:-@\[-`{-~"
# Between a letter or digit and a mark there is always a border of pre-tokens.
_RUN = rf"[^\W_]+(?=[{SPACE}{_MARK}]|\Z)|[{_MARK}]+(?=[^\W_]|[{SPACE}]|\Z)|[^{SPACE}]+"
_SPACED = re.compile(f"[{SPACE}]*(?:{_RUN})|[{SPACE}]+")
_WORDS = re.compile(_RUN)
_CUT = re.compile(f"(?<=[^{SPACE}{_ODD_SPACE.pattern[1:-1]}])[{SPACE}]")

# Bounds of memory, not of results: pieces kept per worker, the longest piece kept, and
# the characters of a text taken at a time.
CACHE_PIECES = 700_000
CACHE_PIECE_CHARS = 64
SLICE_CHARS = 1_000_000


# Letters of which every pre-tokenizer here makes one pre-token, and normalizers only
# change the case; samples to see whether the library agrees.
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SAMPLES = ("a", " the", "Über", " élan", "Zzyzx", " Straße", "ño", "A", " WORDS", "unbelievably")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes as: printable ones as themselves,
    the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Ids of a tokenizer file without added special tokens, as numpy arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._tokenize = self.tokenizer.model.tokenize
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        added = self.tokenizer.get_added_tokens_decoder()
        self._added = {t.content for t in added.values()}
        self._apart = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")
        self._separator, self._separator_id = next(
            ((t.content, i) for i, t in added.items() if t.special and not (t.normalized or t.lstrip or t.rstrip)),
            (None, None))
        self._drops_space = self._direct("a b") == self._direct("a \n b") == self._direct("a") + self._direct("b")
        self._pattern = _WORDS if self._drops_space else _SPACED
        self._cache: dict[str, bytes] = {}
        self._letters = _byte_letters()
        self._lowers = self._direct("A") == self._direct("a")
        self._by_model = True
        self._by_model = all(self._word(w) == self._bytes(w) for w in _SAMPLES)

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.asarray(self._direct(text), dtype=self.dtype).tobytes()

    def _word(self, piece: str) -> bytes | None:
        """Ids of a single pre-token, straight from the library's model; None for others."""
        if not self._by_model or not _LETTERS.fullmatch(piece):
            return None
        if self._drops_space:
            piece = piece.strip(" ")
        if self._lowers:
            piece = piece.lower()
        units = piece.encode().decode("latin-1").translate(self._letters)
        return array(self._code, [t.id for t in self._tokenize(units)]).tobytes()

    def pieces(self, text: str) -> list[str]:
        """Parts of a text whose ids, in order, are the ids of the text."""
        if not text:
            return []
        if self._added and any(a in text for a in self._added):
            return [p for part in self._apart.split(text) for p in ([part] if part in self._added else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        pieces = self._pattern.findall(text)
        if not self._drops_space and _ODD_SPACE.search(text):
            # ASCII white space after odd white space may belong to the same run.
            joined: list[list[str]] = []
            for piece in pieces:
                if joined and _ODD_SPACE.match(joined[-1][-1][-1]):
                    joined[-1].append(piece)
                else:
                    joined.append([piece])
            return ["".join(parts) for parts in joined]
        return pieces

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of pieces that are not kept yet; those that are too long or hold special
        tokens are returned instead of kept."""
        if len(self._cache) > CACHE_PIECES:
            self._cache.clear()
        cache = self._cache
        new = [p for p in set(pieces) if p not in cache]
        apart = {p: self._bytes(p) for p in new if len(p) > CACHE_PIECE_CHARS or p in self._added}
        short = []
        for piece in new:
            if piece not in apart:
                ids = self._word(piece)
                if ids is None:
                    short.append(piece)
                else:
                    cache[piece] = ids
        if self._separator is None:
            cache.update({p: self._bytes(p) for p in short})
        elif short:
            text = self._separator.join(short)
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self._separator_id).tolist() + [len(ids)]
            data, size, start = ids.tobytes(), self.dtype.itemsize, 0
            for piece, end in zip(short, ends, strict=True):
                cache[piece] = data[start * size:end * size]
                start = end + 1
        return apart

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE_CHARS:
            cut = _CUT.search(text, start + SLICE_CHARS)
            if cut is None:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def piece_counts(self, pieces: list[str]) -> list[int]:
        """The number of ids of each piece."""
        apart = self._learn(pieces)
        cache, size = self._cache, self.dtype.itemsize
        if not apart:
            return [len(cache[p]) // size for p in pieces]
        return [len(apart[p] if p in apart else cache[p]) // size for p in pieces]

    def encode_group(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.pieces(t) for t in texts]
        apart = self._learn(itertools.chain.from_iterable(parts))
        get = {**self._cache, **apart}.__getitem__ if len(apart) > 1000 else (
            self._cache.__getitem__ if not apart else lambda p: apart[p] if p in apart else self._cache[p])
        return [np.frombuffer(b"".join(map(get, p)), dtype=self.dtype) for p in parts]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        found = [self.encode_group([s])[0] for s in self._slices(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn; short texts share calls of the library."""
        group: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if size + len(text) > SLICE_CHARS and group:
                yield from self.encode_group(group)
                group, size = [], 0
            if len(text) > SLICE_CHARS:
                yield self.encode(text)
            else:
                group.append(text)
                size += len(text)
        yield from self.encode_group(group)


@functools.cache
def encoder(name: str) -> Encoder:
    """The encoder of a tokenizer, once per worker: a file of public_tokenizers or a path."""
    import public_tokenizers

    return Encoder(name if os.sep in name else public_tokenizers.path(name))
