"""Token counts without token ids: byte-pair merging by a heap over a linked list.

A text is cut as the byte-level vocabulary prescribes; each piece starts as its bytes, and the adjacent pair of lowest
merge rank (leftmost first) is merged until none is left. Tokens = initial symbols - merges, so no id is ever made.
The heap keeps a piece of n bytes at O(n log n), however long it is; repeated chunks are looked up in a bounded cache.

Special strings (``<|endoftext|>``) inside a text count as one token each, as the library does by default.
Null text: empty, 0 tokens. Rows are handled one by one, so repeated rows, ties, clashing extra columns and empty
tables have no effect on each other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Memo, store, tokenizer_path

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces, as the byte-level pre-tokenizer cuts them.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Larger chunks whose ends are always ends of pieces: a word with the one space before it, or white space.
CHUNKS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class MergeTable:
    """Merge ranks of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, pre = data["model"], data.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or data.get("normalizer") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        vocab = model["vocab"]
        self.first = [vocab[c] for c in byte_chars()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.pieces = Memo(self.symbols)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.made.append(vocab[left + right])
        specials = sorted((t["content"] for t in data.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def symbols(self, piece: bytes) -> int:
        """Symbols left when no adjacent pair can be merged any more."""
        left = count = len(piece)
        if left < 2:
            return left
        rank, made = self.rank, self.made
        symbol = [self.first[b] for b in piece]
        after, before = list(range(1, left + 1)), list(range(-1, left - 1))
        heap = []
        for at in range(left - 1):
            r = rank.get(symbol[at] << 32 | symbol[at + 1])
            if r is not None:
                heap.append(r << 40 | at)
        heapify(heap)
        while heap:
            top = heappop(heap)
            at, r = top & 0xFFFFFFFFFF, top >> 40
            follows = after[at]
            if symbol[at] < 0 or follows >= count or rank.get(symbol[at] << 32 | symbol[follows]) != r:
                continue  # one of the two was merged meanwhile
            symbol[at], symbol[follows] = made[r], -1
            after[at] = beyond = after[follows]
            left -= 1
            if beyond < count:
                before[beyond] = at
                r = rank.get(symbol[at] << 32 | symbol[beyond])
                if r is not None:
                    heappush(heap, r << 40 | at)
            if (prior := before[at]) >= 0:
                r = rank.get(symbol[prior] << 32 | symbol[at])
                if r is not None:
                    heappush(heap, r << 40 | prior)
        return left

    def chunk(self, chunk: str) -> int:
        return sum(self.pieces[piece.encode()] for piece in PIECES.findall(chunk))


def counter(path: str):
    """A function from text to its number of tokens, with the worker's tables and caches."""
    kept = store("count")
    if ("count", path) not in kept:
        table = MergeTable(path)
        kept["count", path] = table, Memo(table.chunk, 600_000)
    table, memo = kept["count", path]

    def plain(text: str) -> int:
        return sum(map(memo.__getitem__, CHUNKS.findall(text)))

    def count(text: str) -> int:
        if table.special and (parts := table.special.split(text))[1:]:
            return len(parts) - 1 + sum(map(plain, parts))
        return plain(text)

    return count


def count_tokens(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text. No shuffle."""
    path = tokenizer_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            tokens = [count(x.as_py()) for x in text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(text), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
