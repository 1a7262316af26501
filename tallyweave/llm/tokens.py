"""Token ids of a byte-level vocabulary file by the tokenizers library, with a bounded memo of words.

The vocabulary's pre-tokenizer never lets a token cross from a visible character to a single following space or
newline, nor from a letter to a full stop or comma. So a text may be cut there, equal pieces encoded once, and the ids
joined: the result is the library's own (tests compare with an untouched tokenizer). Texts with other white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import worker_cache

#: Words that the byte-level pre-tokenizer leaves whole.
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
# The byte-level alphabet: visible Latin-1 characters stand for their bytes, the other bytes for U+0100 and on, in order.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}
#: Pieces kept per Python worker; beyond that the memo starts anew. About 150 bytes each.
MEMO = 600_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """Piece -> packed ids. A piece is a word after a space, or a newline and a word. Other pieces raise KeyError."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        first = piece[:1] == "\n"
        word, enc = piece[1:] if first else piece, self.encoder
        if WORD.fullmatch(word):
            # straight to the library's model, in its alphabet for bytes
            plain = word if word.isascii() else word.encode().decode("latin-1").translate(ALPHABET)
            ids = enc.packed([t.id for t in enc.bpe(plain if first else enc.space + plain)])
            ids = enc.line + ids if first else ids
        elif word[-1:] in (".", ",") and WORD.fullmatch(word, 0, len(word) - 1):
            ids = self[piece[:-1]] + enc.ends[word[-1]]
        elif len(word.split()) != 1 or word.strip() != word:
            raise KeyError(piece)
        else:
            ids = enc.whole(piece if first else " " + piece)
        self[piece] = ids
        return ids


class Encoder:
    """ids(text) -> numpy uint16 or uint32 array. One for each worker and vocabulary file.

    The strings of special tokens in a text give those tokens' ids, as the library does by itself; with special_as_text they are ordinary text.
    """

    def __init__(self, path: str, memo: int = MEMO, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        self.memo, self.known = memo, Pieces(self)
        self.bpe, code = self.tok.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        self.packed = lambda ids: array(code, ids).tobytes()
        self.space, self.line, self.ends = chr(ALPHABET[32]), self.whole("\n"), {c: self.whole(c) for c in ".,"}

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        cache, key = worker_cache(), ("encoder", path)
        if key not in cache:
            cache[key] = cls(path)
        return cache[key]

    def whole(self, text: str) -> bytes:
        return self.packed(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def forget(self) -> None:
        """Empties the memo; a task does so at its end, since idle workers keep their memory."""
        self.known.clear()

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, no special token added. Null and empty texts: none."""
        if not text:
            return np.zeros(0, self.dtype)
        if any(s in text for s in self.special):
            return np.frombuffer(self.whole(text), self.dtype)
        if len(self.known) > self.memo:
            self.forget()
        # a newline before the text, whose id is taken off again, makes its first word like any other line's
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\n" + pieces[0]
        try:
            got = b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            return np.frombuffer(self.whole(text), self.dtype)
        return np.frombuffer(got, self.dtype, offset=len(self.line))
