"""Token ids of whole texts with a public tokenizer file, fast enough for a Spark task."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

END_ID = 1
GAP = re.compile(r"[\x20\x09-\x0D]+")
#: Lower-case Latin-1 letters, which normalisation leaves alone, then punctuation: there the ids always split.
#: Apostrophes (contractions) and "<" (special tokens) are left to the whole tokenizer.
WORD_AND_TAIL = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=>?@\[-`{-~]*)").fullmatch


#: White space for ``str.split`` that is none for the tokenizer; all other white space is dropped by both.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def split(text: str) -> list[str]:
    """The chunks of a text."""
    return GAP.split(text) if any(c in text for c in SEPARATORS) else text.split()


#: Bytes of one generation of cached chunks and their ids, and what one entry costs besides them.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 180
LONG_CHUNK = 64
#: What a tokenizer is tried on: if it does not give whole texts the ids of their chunks in turn, it is given whole texts.
PROBES = ("a b", " a  b\n", "Some WORDS, here.\n\tAnd (more) \u2013 don't!  x's", "\u00e9t\u00e9 \u00df \ufb01 \u0391\u03a3. \u65e5\u672c 12,000.5 a_b", "re-use a/b <x> #1 ... end")


class ChunkEncoder:
    """Encodes texts by their white-space separated chunks, each distinct chunk once.

    Valid for tokenizers that drop white space, never join text across it, lower-case,
    and mark the last token of a word (``word_bpe_49k.json`` is one); then the ids
    of a text are those of its chunks in turn. PROBES tell; any other tokenizer is
    given whole texts (``by_chunks`` is false). The library encodes every word that
    is not cached. Two generations of at most ``limit`` bytes each bound the
    memory; chunks of over LONG_CHUNK letters, which hardly recur, are not kept.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.code = "H" if max(vocabulary.values()) < 1 << 16 else "I"
        self.width = 2 if self.code == "H" else 4
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.limit, self.bytes = limit, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.by_chunks = self.tokenizer.normalizer is not None and self.tokenizer.pre_tokenizer is not None
        if self.by_chunks:
            self.spelled = {c: self._spelled(chr(c)) for c in range(0x80, 0x100) if chr(c).isalpha() and chr(c).islower()}
            self.by_chunks = list(self.encode(PROBES)) == list(self._whole(PROBES))
            self.new, self.bytes = {}, 0

    def _spelled(self, letter: str) -> str:
        """How the tokenizer's normaliser and pre-tokenizer spell a letter for its model."""
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(letter))
        return "".join(part for part, _ in found)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, packed little-endian in ``width`` bytes each; null counts as empty."""
        if not self.by_chunks:
            yield from self._whole(texts)
            return
        chunks = [split(text or "") for text in texts]
        wanted = set().union(*chunks)
        self._learn(wanted)
        look_up = self.new.__getitem__
        for parts in chunks:
            yield b"".join(map(look_up, parts))
        for chunk in wanted:
            if len(chunk) > LONG_CHUNK:
                self.new.pop(chunk, None)

    def _whole(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            yield np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, self.code).tobytes()

    def rest(self) -> None:
        """Between tasks: keep the newer generation only, so that an idle worker holds little."""
        self.old = {}

    def _learn(self, chunks: set[str]) -> None:
        if self.bytes > self.limit:
            self.old, self.new, self.bytes = self.new, {}, 0
        size = len(self.new)
        self._add(chunks)
        self.bytes += (len(self.new) - size) * ENTRY_BYTES  # of at most LONG_CHUNK letters each, once the longer ones are gone

    def _add(self, chunks: set[str]) -> None:
        new, old = self.new, self.old
        split, words, others = [], set(), []
        for chunk in chunks.difference(new):
            known = old.get(chunk)
            if known is not None:
                new[chunk] = known
                continue
            parts = WORD_AND_TAIL(chunk.lower())
            if parts is None:
                others.append(chunk)
                continue
            word, tail = parts.groups()
            split.append((chunk, word, tail))
            if word not in new:
                known = old.get(word)
                if known is None:
                    words.add(word)
                else:
                    new[word] = known
        self._encode_words(list(words))
        others.extend(tail for tail in {tail for _, _, tail in split} if tail not in new)
        self._encode_others(others)
        for chunk, word, tail in split:
            new[chunk] = new[word] + new[tail]

    def _encode_words(self, words: list[str]) -> None:
        """Words of Latin letters in one call of the model: each becomes the tokens up to the next that ends a word."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            line = " ".join(part)
            if not line.isascii():
                line = line.translate(self.spelled)
            ids = np.array(self.words.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.code)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                self._encode_others(part)
                continue
            packed, low = ids.tobytes(), 0
            for word, high in zip(part, (ends * self.width).tolist(), strict=True):
                self.new[word] = packed[low:high]
                low = high

    def _encode_others(self, chunks: list[str]) -> None:
        for chunk, found in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.new[chunk] = np.array(found.ids, self.code).tobytes()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> ChunkEncoder:
    """This worker process's encoder for a tokenizer file; a reused worker keeps its cache, within the bytes now asked for."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    _ENCODERS[path].limit = cache_bytes
    return _ENCODERS[path]


def small_runs(lengths: list[int], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose lengths sum to about ``most`` (a longer row stands alone)."""
    start = total = 0
    for i, length in enumerate(lengths):
        if total and total + length > most:
            yield start, i
            start, total = i, 0
        total += length
    if start < len(lengths):
        yield start, len(lengths)
