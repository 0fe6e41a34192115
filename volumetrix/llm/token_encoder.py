"""Exact ids of the public word-end BPE, with bounded caches of chunks and words.

The vocabulary's words never hold white space and are encoded one by one, so the ids of a text are
the ids of the chunks between its white space, and those the ids of their words. Texts of plain
Latin characters take that way; any other text, and one that holds the string of an added token
(which the tokenizer gives its own id), goes through the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Last letter of the alphabets that ``WORDS`` spells out.
LAST_LETTER = 0x24F
#: Characters that normalisation leaves alone but for their case, whose lower case ``WORDS`` knows, and whose white space is plain.
PLAIN = "[\t\n\r" + "".join(re.escape(c) for c in map(chr, [*range(0x20, 0x7F), *range(0xA1, LAST_LETTER + 1)]) if len(c.lower()) == 1 and ord(c.lower()) <= LAST_LETTER) + "–—‘’“”…€]*"
#: The vocabulary's words, written for lower-case plain characters.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ɏ0-9²³¹¼½¾]+"
VOCABULARY = "word_bpe_49k.json"
#: Chunks and words after which the present generation of the cache becomes the old one, and the old one is given up.
CACHE_ENTRIES = 120_000
#: Characters of text that are cut at once.
BLOCK_CHARS = 4_000_000

_ENCODERS: dict[str, "WordEncoder"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "WordEncoder":
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, others start at 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.bpe = self.tokenizer.model.tokenize
        self.alphabet = {ord(chr(b)): c for b, c in byte_alphabet().items()}
        self.cut = re.compile(WORDS).findall
        self.plain = re.compile(PLAIN).fullmatch
        self.entries = entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def is_plain(self, text: str) -> bool:
        return self.plain(text) is not None and not any(x in text for x in self.added)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a word, or of a chunk that is one word. What the old generation still knows moves to the young one."""
        ids = self.young.get(word) or self.old.get(word)
        if ids is None:
            found = self.bpe(word.encode().decode("latin-1").translate(self.alphabet))
            ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        if len(word) <= 64:
            self.young[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            words = self.cut(chunk)
            if len(words) == 1:
                return self._word(chunk)
            ids = b"".join(map(self._word, words))
        if len(chunk) <= 64:
            self.young[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order, as unsigned 32-bit integers."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Distinct chunks of the block are looked up once; Arrow puts their ids back in place."""
        plain = [self.is_plain(t) for t in texts]
        column = pa.array([t if p else "" for t, p in zip(texts, plain)], pa.large_string())
        lists = pc.ascii_split_whitespace(pc.utf8_lower(column))
        coded = lists.flatten().dictionary_encode()
        if len(self.young) >= self.entries:
            self.young, self.old = {}, self.young
        known, unknown = self.young.get, self._chunk
        packed = [known(c) or unknown(c) for c in coded.dictionary.to_pylist()]
        placed = pa.array(packed, pa.large_binary()).take(coded.indices)
        data = placed.buffers()[2]
        ids = np.frombuffer(data, np.uint32) if data else np.empty(0, np.uint32)
        ends = np.frombuffer(placed.buffers()[1], np.int64)[placed.offset : placed.offset + len(placed) + 1] // 4
        starts = ends[np.asarray(lists.offsets)]
        for k, text in enumerate(texts):
            yield ids[starts[k] : starts[k + 1]] if plain[k] else np.frombuffer(self._whole(text), np.uint32)
