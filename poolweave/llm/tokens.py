"""Token ids of whole texts by a public byte-level BPE file, with a word cache.

A byte-level BPE splits a text before merging, and no piece holds a space anywhere but at its start. Between a
non-space and a space the split therefore never depends on what stands on the other side, so a text may be encoded
word by word (each with its leading space) and each different word once. Runs of white space around a space are the
one case where that does not hold: such texts are encoded whole. `tests/llm` compares both ways on hostile texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .shared import utf8

#: Entries of the word cache of one Python worker; beyond, it starts afresh.
CACHE_WORDS = 900_000
#: Entries of its cache of pieces of words not met yet, many of which differ in their marks only.
CACHE_PIECES = 200_000
TYPE = np.dtype("<u2")
#: ASCII marks; an apostrophe may begin a piece of letters.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def _letters() -> dict[int, int]:
    """Byte-level BPE writes bytes as letters: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


LETTERS = _letters()
_ODD = re.compile(r"\s \s")
#: A space behind white space: without one of these, no space has white space on both sides.
_PAIRS = [f"{chr(c)} " for c in range(0x3001) if chr(c).isspace()]


class Words(dict):
    """Ids by word; those of a word not met yet are worked out when it is asked for."""

    def __init__(self, word: Callable[[str], bytes]) -> None:
        super().__init__()
        self.word = word

    def __missing__(self, text: str) -> bytes:
        out = self[text] = self.word(text)
        return out



def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """encode(text) -> ids as little-endian unsigned 16-bit bytes (32-bit where the vocabulary needs it)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.type = TYPE if self.inner.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.model = self.inner.model
        self.bytes = [self.type.type(i).tobytes() for i in range(self.inner.get_vocab_size())]
        self.pieces = Words(self.piece)
        self.seen = Words(self.word)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, text: str) -> bytes:
        """Of a text that the split leaves in one piece."""
        data = text.replace(" ", "\u0120") if text.isascii() and text != "\n" else text.encode().decode("latin-1").translate(LETTERS)
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(data)])

    def plain(self, text: str) -> bytes | None:
        """Letters (a space may lead them), and ASCII marks after them, are a piece each and need no splitting."""
        letters = text.rstrip(_MARKS)
        if not (letters[1:] if letters[:1] == " " else letters).isalpha():
            return None
        return self.pieces[letters] + self.pieces[text[len(letters) :]] if len(letters) < len(text) else self.pieces[letters]

    def word(self, text: str) -> bytes:
        """Of one word with its leading space. A line break between two that are plain is a piece, too."""
        if (got := self.plain(text)) is not None:
            return got
        if "\n" in text and None not in (parts := [self.plain(x) for x in text.split("\n")]):
            return self.pieces["\n"].join(parts)
        return self.ids([text])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of whole texts; null counts as empty."""
        texts = ["" if t is None else t if t.isascii() else utf8(t).decode("utf-8", "replace") for t in texts]
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        get, join, out = self.seen.__getitem__, b"".join, []
        for t in texts:
            if "\0" in t or "<|" in t or any(x in t for x in _PAIRS) and _ODD.search(t):
                out.append(self.ids([t])[0])
            else:
                out.append(join(map(get, t.replace(" ", "\0 ").split("\0"))))
        return out

    def with_end(self, texts: list[str | None], end: int) -> list[bytes]:
        tail = self.type.type(end).tobytes()
        return [x + tail for x in self.encode(texts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker; its cache lives as long as the worker."""
    return Encoder(path)


def groups(texts: list, size: int = 4 << 20):
    """Slices of a list of texts of about size characters, so that memory follows the slice and not the batch."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
