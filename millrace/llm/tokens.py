"""Byte-level BPE by the tokenizers library, with a memo of space-parted pieces in front of it.

Byte-level BPE first parts a text by a pattern whose matches never hold a space after another character. A text without
white space beside a space can so be cut before every space, and the ids of the pieces joined are the ids of the text.
Every other text goes to the library whole.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Bytes that a memo holds, about, before it grows old; an old memo still answers until the next one has grown. ENTRY: what an entry takes beside its piece and ids.
MEMO, ENTRY = 64 << 20, 200
#: Bytes of text that are encoded together.
TOGETHER = 4 << 20


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.encode_special_tokens = True  # the strings of special tokens in a text are ordinary text
    return tokenizer


class Encoder:
    """Ids of texts as numpy arrays of the given type. tokenizer: one of byte-level BPE."""

    def __init__(self, tokenizer: Tokenizer, dtype: str = "<u4"):
        self.tokenizer, self.dtype = tokenizer, np.dtype(dtype)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.spaced = np.zeros(tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.new: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes | None] = {}
        self.held = self.held_heads = 0
        self.marks = {c: self.whole(c) for c in ".,"}

    def whole(self, text: str) -> bytes:
        """The ids of one text, by the library alone."""
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Adds pieces that follow a space. None: the piece has white space at an end, or is empty."""
        new, old = self.new, self.old
        ask: set[str] = set()
        marked = []
        for p in pieces:
            if p in old:
                new[p] = old[p]
            elif not p or p != p.strip():
                new[p] = None
            elif p[-1] in self.marks and p[:-1].isalpha():  # letters and a mark are matched apart
                marked.append(p)
                if p[:-1] not in new:
                    ask.add(p[:-1])
            else:
                ask.add(p)
        each = list(ask)
        for start in range(0, len(each), 1024):
            self._ask(each[start : start + 1024])
        for p in marked:
            new[p] = new[p[:-1]] + self.marks[p[-1]]
        self.held += sum(map(len, pieces)) + sum(map(len, filter(None, map(new.__getitem__, pieces)))) + ENTRY * (len(pieces) + len(marked))

    def _ask(self, pieces: list[str]) -> None:
        """Encodes pieces as one text; of its tokens, those that begin with a space begin a piece."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = (np.flatnonzero(self.spaced[ids]) * self.dtype.itemsize).tolist()
        if len(cuts) != len(pieces):  # a piece holds white space or a token of another kind
            self.new.update((p, self.whole(" " + p)) for p in pieces)
            return
        raw = ids.tobytes()
        self.new.update(zip(pieces, [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        cut = [(t or "").split(" ") for t in texts]
        if self.held > MEMO:
            self.new, self.old, self.held = {}, self.new, 0
        if self.held_heads > MEMO // 4:
            self.heads, self.held_heads = {}, 0
        heads = [c.pop(0) for c in cut]
        unknown = set(heads) - self.heads.keys()
        self.heads.update((h, self.whole(h) if h == h.strip() else None) for h in unknown)
        self.held_heads += sum(ENTRY + len(h) + len(self.heads[h] or b"") for h in unknown)
        self._learn(set().union(*cut) - self.new.keys())
        out, get = [], self.new.__getitem__
        for text, head, rest in zip(texts, heads, cut, strict=True):
            try:
                ids = self.heads[head] + b"".join(map(get, rest)) if text else b""
            except TypeError:  # a piece with white space at an end
                ids = self.whole(text)
            out.append(np.frombuffer(ids, self.dtype))
        return out


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary; its memo lives on from task to task. Ids take two bytes where the vocabulary allows."""
    tokenizer = load(name)
    return Encoder(tokenizer, "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
