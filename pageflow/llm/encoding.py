"""Fast exact encoding with the tokenizers library: each distinct chunk of a text is encoded once per worker.

A text is cut only where the vocabulary's own rules cut in any case: at ASCII white space where the vocabulary drops
white space and case; where it is byte-level, at single spaces between words, else by `bpe_count.CHUNKS`. So joining the
chunks' ids gives the ids of the whole text. Chunks are cut into the vocabulary's pieces, and the library's merge model
encodes the pieces that are new. What the cutting rules here don't cover goes to the
library whole: texts that hold a special string (in any case), and words outside Latin letters and signs where the
vocabulary normalises.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .bpe_count import CHUNKS, PIECES, byte_chars
from .common import Memo, store

#: Pieces of lower-case words, as the vocabulary with word ends cuts them.
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words that its normalisation leaves as they are, but for upper-case letters.
_LATIN = re.compile("[!-~¡-ɏ]+")
#: Signs that follow a letter as one piece.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Loose(Exception):
    """White space beside a space: how that is cut depends on what follows."""


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # the same vocabulary without normalising and cutting
        self.byte_level = (data.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.folds = data["model"].get("end_of_word_suffix") == "</w>"
        if not (self.byte_level and not data.get("normalizer") or self.folds):
            raise ValueError(f"{path}: neither byte-level nor with word ends")
        if self.folds:
            self.spaces = Tokenizer(self.tokenizer.model)  # it cuts at white space, which no piece in the vocabulary's signs has
            self.spaces.pre_tokenizer = WhitespaceSplit()
            names = self.merges.get_vocab()
            self.last = np.zeros(max(names.values()) + 1, bool)
            self.last[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.chars = dict(enumerate(byte_chars()))
        self.specials = [t["content"].lower().encode() for t in data.get("added_tokens", [])]
        self.limit = limit
        #: ids by piece, by chunk, and by word for chunks of a space and a word.
        self.pieces = Memo(self._piece, limit)
        self.chunks = Memo(self._chunk, limit)
        self.spaced = Memo(self._spaced, limit)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.chars)
        return array("I", self.merges.encode(mapped, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(chunk)))

    def _spaced(self, word: str) -> bytes:
        """Ids of a word and the space before it."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Loose
        head = word.rstrip(_SIGNS)
        if not head.isalpha():
            return self._chunk(" " + word)
        return self.pieces[" " + head] + self.pieces[word[len(head) :]] if len(head) < len(word) else self.pieces[" " + word]

    def _bytes(self, text: str) -> bytes:
        """Ids where all bytes are kept."""
        first, *words = text.split(" ")
        if words and not first[-1:].isspace():
            try:
                rest = b"".join(map(self.spaced.__getitem__, words))
                return b"".join(map(self.chunks.__getitem__, CHUNKS.findall(first))) + rest
            except _Loose:
                pass
        return b"".join(map(self.chunks.__getitem__, CHUNKS.findall(text)))

    def _joined(self, mapped: list[str], some: int = 128) -> tuple[bytes, list[int]]:
        """Ids of all pieces and where each begins and ends; `some` pieces are one text to the library, cut at spaces.

        A piece's last token, and no other, ends with the sign for that. Where the counts of both differ, each is a text.
        """
        texts = [" ".join(mapped[k : k + some]) for k in range(0, len(mapped), some)]
        ids = [np.array(e.ids, np.uint32) for e in self.spaces.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(mapped):
            return ids.tobytes(), [0, *(4 * ends).tolist()]
        each = [e.ids for e in self.merges.encode_batch_fast(mapped, add_special_tokens=False)]
        return array("I", chain.from_iterable(each)).tobytes(), [0, *accumulate(4 * len(x) for x in each)]

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of new words into the cache; their new pieces are one call of the library."""
        heads, tails, plain, cut = [], [], [], {}
        for word in words:
            head = word.rstrip(_SIGNS)
            if head.isalpha() and word.isascii():  # most words; they are in lower case
                plain.append(word)
                heads.append(head)
                tails.append(word[len(head) :])
                continue
            text = word.lower() if _LATIN.fullmatch(word) else None
            if text is None or not _LATIN.fullmatch(text):
                self.chunks[word] = self._whole(word)
                continue
            head = text.rstrip(_SIGNS)
            cut[word] = ([head, text[len(head) :]] if len(head) < len(text) else [text]) if head.isalpha() else _WORD_PIECES.findall(text)
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        new = list({p for parts in cut.values() for p in parts}.union(heads, tails).difference(self.pieces, ("",)))
        ids, ends = self._joined([p if p.isascii() else p.encode().decode("latin-1").translate(self.chars) for p in new])  # visible ASCII stands for itself
        self.pieces.update((p, ids[a:b]) for p, a, b in zip(new, ends, ends[1:], strict=False))
        get = self.pieces.__getitem__
        self.chunks.update((w, get(h) + get(t) if t else get(h)) for w, h, t in zip(plain, heads, tails, strict=True))
        self.chunks.update((c, get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts))) for c, parts in cut.items())

    def _words(self, folded: list[bytes]) -> Iterator[bytes]:
        """Ids where white space and case are dropped. Arrow tells the distinct words of a group and puts their ids in place."""
        lists = pc.ascii_split_whitespace(pa.array(folded, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        every = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py().split("\n") if len(words) else []
        new = [w for w in every if w not in self.chunks]
        if len(self.chunks) + len(new) > self.limit:
            self.chunks.clear()
            new = every
        self._learn(new)
        ids = pa.array(list(map(self.chunks.__getitem__, every)), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        ends = at[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for a, b in zip(ends, ends[1:], strict=False):
            yield bytes(data[a:b])

    def _group(self, texts: list[bytes]) -> Iterator[bytes]:
        folded = [t.lower() for t in texts]
        special = [any(s in t for s in self.specials) for t in folded]
        if self.byte_level:
            rest = (self._bytes(t.decode()) for t, s in zip(texts, special, strict=True) if not s)
        else:
            rest = self._words([t for t, s in zip(folded, special, strict=True) if not s])
        for text, s in zip(texts, special, strict=True):
            yield self._whole(text.decode()) if s else next(rest)

    def encode_all(self, texts: list[bytes], group: int = 4 << 20) -> Iterator[bytes]:
        """ids of each text, in order; texts are taken in groups of about `group` bytes."""
        some, size = [], 0
        for data in texts:
            some.append(data)
            size += len(data)
            if size >= group:
                yield from self._group(some)
                some, size = [], 0
        yield from self._group(some)

    def encode(self, data: bytes) -> bytes:
        return next(self.encode_all([data]))


def encoder(path: str) -> Encoder:
    kept = store("encode")
    if ("encode", path) not in kept:
        kept["encode", path] = Encoder(path)
    return kept["encode", path]
