"""Token ids of whole texts: a vocabulary file applied word by word, each distinct word once per worker.

The vocabulary's pre-tokenizer never joins what an ASCII blank separates, so a text's ids are its words' ids one after
the other, and a word's ids need to be found only once. The memo is bounded: two generations of words, of which the
older goes when the younger is full.
"""

from __future__ import annotations

import os
import re
from struct import pack

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: The pieces of a lower-cased word of Latin-1 characters: the vocabulary file's own pattern, its letters and numbers spelt out.
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")
LATIN = re.compile("[\\x00-\\x84\\x86-\\x9f\\xa1-\\xff]+")  # without the two blanks among them
#: Byte-level vocabularies write printable bytes as they are and the others, in order, as the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PLAIN]
BYTE_LEVEL = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_OTHER)}
#: Texts with these strings are encoded as they are: the vocabulary looks for them before anything else.
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")

#: The vocabulary used unless another file is named, and the id that ends each document.
VOCABULARY, END = "word_bpe_49k.json", 1


class WordIds(dict):
    """Lower-cased word (bytes) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most, self.older = Tokenizer.from_file(path), most, {}
        self.bpe = self.tokenizer.model.tokenize

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        ids = [x.id for x in self.bpe(text)]
        return pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():  # ASCII letters only: one piece that normalization leaves as it is
                ids = self.piece(word.decode())
            elif LATIN.fullmatch(text := word.decode()):
                parts = PIECES.findall(text.lower())
                ids = b"".join([self[x.encode()] for x in parts]) if len(parts) > 1 else self.piece(parts[0].encode().decode("latin-1").translate(BYTE_LEVEL))
            else:
                ids = self.whole(word)
        if len(word) <= 64:  # very long words are rare and would make the memo's size unbounded
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


_memo: dict[str, WordIds] = {}


def word_ids(vocabulary: str | None = None) -> WordIds:
    """This worker's memo of a vocabulary: a path, or a file name of the public tokenizers."""
    name = vocabulary or VOCABULARY
    if name not in _memo:
        _memo[name] = WordIds(name if "/" in name else public_tokenizers.path(name))
    return _memo[name]


def text_ids(texts: list[bytes], words: WordIds, end: int = END) -> list[bytes]:
    """The ids of each text with the end id, as bytes."""
    tail = np.array([end], "<u4").tobytes()
    special = lambda x: any(s in x for s in SPECIAL)
    return [(words.whole(x) if special(x) else b"".join(map(words.__getitem__, x.lower().split()))) + tail for x in texts]
