"""Token ids of whole texts, with the ids of repeated chunks remembered.

Both vocabularies cut texts into words before they merge bytes, and no word crosses a single space
(the byte-level one puts the space at the head of the next word; the word-level one drops it). So a
text's ids are the ids of its space-separated chunks, one after another, and each distinct chunk is
encoded once by the ``tokenizers`` library. A chunk that is only letters and then only ASCII
punctuation is two words to either vocabulary; its letters are given to the library's merge model by
themselves, so ``word``, ``word,`` and ``word.`` merge once; so do the words on both sides of a line break. Texts where a cut could matter, those
with a space between two other white-space characters or at the end after one, or with a control
token in the byte-level vocabulary, go to the library whole. The memory of chunks is bounded
in bytes: when it is full, only the chunks of the texts at hand stay, and chunks of over ``LONG_CHUNK``
characters (texts without spaces) are not remembered at all.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable
from functools import lru_cache

ODD_SPACE = re.compile(r"\s \s|\s \Z")
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"  # ASCII punctuation but ', which starts contractions, and <, >, which may start control tokens
MEMORY, LONG_CHUNK, ENTRY_BYTES = 160 << 20, 64, 200
BYTE_LEVEL, WORD_LEVEL = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, leading_space: bool, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.names = _byte_names()
        self.leading_space = leading_space
        self.controls = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory, self.used = memory, 0
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {"": self._ids([" "])[0] if leading_space else b""}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        named = word.replace(" ", "\u0120") if plain else word.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.merge(named)]).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self._merged(word)
            if len(word) <= LONG_CHUNK:
                self.words[word] = found
                self.used += self._cost(word, found)
        return found

    def _after_space(self, letters: str, chunk: str) -> bytes:
        """The ids of ``chunk``, which begins with ``letters`` and goes on with punctuation, behind a space. Its letters are a chunk that is remembered too."""
        found = self.known.get(letters)
        if found is None:
            found = self._merged(" " + letters)
            if len(letters) <= LONG_CHUNK and letters != chunk:
                self.known[letters] = found
                self.used += self._cost(letters, found)
        return found + self._word(chunk[len(letters) :]) if len(letters) < len(chunk) else found

    def _broken(self, chunk: str) -> bytes | None:
        """The ids of a word, a line break and another word, either with punctuation behind it; None for other chunks."""
        before, mark, after = chunk.partition("\n")
        first, second = before.rstrip(TAIL), after.rstrip(TAIL)
        if not (mark and first.isalpha() and second.isalpha()):
            return None
        ids = self._after_space(first, before) + self._word(mark) + self._word(second)
        return ids + self._word(after[len(second) :]) if len(second) < len(after) else ids

    @staticmethod
    def _cost(chunk: str, ids: bytes) -> int:
        return 2 * len(chunk) + len(ids) + ENTRY_BYTES

    def _learn(self, chunks: set[str]) -> list[str]:
        """Afterwards all ``chunks`` are known; those that must be forgotten again come back: long ones, and those around line breaks, which hardly come twice."""
        new = chunks.difference(self.known)
        if self.used > self.memory:
            self.known = {c: self.known[c] for c in chunks - new} | {"": self.known[""]}
            self.words = {}
            self.used = sum(map(self._cost, self.known, self.known.values()))
        known, odd, broken = self.known, [], []
        for c in new:
            letters = c.rstrip(TAIL)
            if letters.isalpha():
                if self.leading_space:
                    known[c] = self._after_space(letters, c)
                elif "Σ" not in letters and unicodedata.is_normalized("NFC", letters) and (lower := letters.lower()).isalpha():
                    ids = self._word(lower)
                    known[c] = ids + self._word(c[len(letters) :]) if len(letters) < len(c) else ids
                else:
                    odd.append(c)
            elif self.leading_space and "\n" in c and (ids := self._broken(c)) is not None:
                known[c] = ids
                broken.append(c)
            else:
                odd.append(c)
        if odd:
            known.update(zip(odd, self._ids([" " + c for c in odd] if self.leading_space else odd), strict=True))
        spent = [c for c in new if len(c) > LONG_CHUNK] + [c for c in broken if len(c) <= LONG_CHUNK]
        self.used += sum(map(self._cost, new, map(known.__getitem__, new))) - sum(map(self._cost, spent, map(known.__getitem__, spent)))
        return spent

    def _whole(self, text: str) -> bool:
        return self.leading_space and (ODD_SPACE.search(text) is not None or any(c in text for c in self.controls))

    def encode(self, texts: Iterable[str], at_once: int = 250_000) -> list[bytes]:
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= at_once:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [None if self._whole(t) else t.split(" ") for t in texts]
        seen: set[str] = set()
        for p in parts:
            if p is not None:
                seen.update(p[1:] if self.leading_space else p)
        spent = self._learn(seen)
        get, out = self.known.__getitem__, []
        heads = self._ids([p[0] if p is not None else t for p, t in zip(parts, texts, strict=True)]) if self.leading_space else []
        for i, p in enumerate(parts):
            if p is None:
                out.append(heads[i])
            elif self.leading_space:
                out.append(heads[i] + b"".join(map(get, p[1:])))
            else:
                out.append(b"".join(map(get, p)))
        for c in spent:
            del self.known[c]
        return out


@lru_cache(maxsize=1)
def worker_encoder(path: str, leading_space: bool) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker, so that later tasks find the chunks of earlier ones."""
    return ChunkEncoder(path, leading_space)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
