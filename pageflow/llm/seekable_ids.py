"""Token-id files of independent zstandard frames with a trailing seek table (the public seekable format).

A part file holds, in ascending doc_id order (null first): one frame per document (long documents: one per
`frame_bytes` of ids), one frame with the document index, and a skippable frame with the seek table: compressed size,
decompressed size and checksum (low 32 bits of XXH64 of the content) of every frame. A reader takes the footer, the
index and only the frames of the documents that it is asked for, and checks each frame that it opens.

Parts are written once under names of their own attempt; the manifest, which Spark commits, says which of them count.
So a lost executor or a second attempt leaves at most an unused file. Null text: empty, the end id alone. Repeated
doc_ids stay separate documents, in the order of their texts; an empty table gives an empty manifest. Long texts are taken
whole, over several frames. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_bytes, tokenizer_path
from .encoding import encoder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ENTRY, _DOC = "<III", "<qQIB"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one part file to a binary stream."""

    def __init__(self, out, *, level: int = 3, frame_bytes: int = 1 << 20):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
        self.seek: list[bytes] = []
        self.index: list[bytes] = []

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.pack(data)
        self.out.write(packed)
        self.seek.append(struct.pack(_ENTRY, len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        before = len(self.seek)
        for at in range(0, len(ids), self.frame_bytes) or [0]:
            self._frame(ids[at : at + self.frame_bytes])
        self.index.append(struct.pack(_DOC, doc_id or 0, len(ids) // 4, len(self.seek) - before, doc_id is None))

    def close(self) -> None:
        self._frame(b"".join(self.index))
        table = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class FrameReader:
    """Reads documents of one part file; `source` has read, seek and tell."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        end = source.seek(0, 2)
        source.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums")
        source.seek(end - 9 - 12 * frames)
        self.seek = list(struct.iter_unpack(_ENTRY, source.read(12 * frames)))
        self.starts, at = [], 0
        for packed, _, _ in self.seek:
            self.starts.append(at)
            at += packed
        self.documents, at = [], 0
        for doc_id, tokens, count, null in struct.iter_unpack(_DOC, self.frame(frames - 1)):
            self.documents.append((None if null else doc_id, tokens, at, count))
            at += count

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, size, checksum = self.seek[k]
        self.source.seek(self.starts[k])
        data = self.unpack(self.source.read(packed), max_output_size=size or 1) if size else b""
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, position: int) -> bytes:
        _, _, first, count = self.documents[position]
        return b"".join(self.frame(k) for k in range(first, first + count))

    def find(self, wanted: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """(doc_id, ids) of the wanted documents; other frames stay packed."""
        wanted = set(wanted)
        for position, (doc_id, *_) in enumerate(self.documents):
            if doc_id in wanted:
                yield doc_id, self.ids(position)


def open_part(uri: str) -> FrameReader:
    system, path = _file_system(uri)
    return FrameReader(system.open_input_file(path))


def write_parts(docs: DataFrame, to: str, *, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, level: int = 3) -> DataFrame:
    """Encodes and writes all documents below the URI `to`; returns the lazy manifest (part, path, documents, tokens).

    One range exchange of the texts by doc_id puts them in order; encoding follows it, so each text is encoded once.
    """
    path = tokenizer_path(tokenizer)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, uri, documents, tokens = None, "", 0, 0
        encode = encoder(path).encode_all
        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encode(text_bytes(batch)), strict=True):
                if writer is None:
                    system, base = _file_system(to)
                    system.create_dir(base)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids.zst"
                    uri, writer = f"{to}/{name}", FrameWriter(system.open_output_stream(f"{base}/{name}", compression=None), level=level)
                ids = encoded + end
                writer.add(doc_id, ids)
                documents, tokens = documents + 1, tokens + len(ids) // 4
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "path": uri, "documents": documents, "tokens": tokens}])

    rows = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    return rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, "part long, path string, documents long, tokens long")


def read_parts(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files.

    The manifest has a row per part file, so what the driver holds to add up the starts is bounded by the task count.
    """
    spark, parts, start = manifest.sparkSession, [], 0
    for row in manifest.orderBy("part").collect():
        parts.append((row.path, start))
        start += row.tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, rows = open_part(path), []
                for position, (doc_id, tokens, _, _) in enumerate(reader.documents):
                    ids = reader.ids(position)
                    if len(ids) != 4 * tokens:
                        raise ValueError(f"{path}: document {doc_id} has {len(ids) // 4} ids, not {tokens}")
                    rows.append((doc_id, start, tokens, zlib.crc32(ids)))
                    start += tokens
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not parts:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(parts, "path string, start long").repartition(len(parts)).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes the files (below `to`, else the shared scratch folder) and returns (manifest, digest of what they hold)."""
    scratch = Scratch(docs.sparkSession)
    manifest = scratch.save(write_parts(docs, to or scratch.path("ids"), tokenizer=tokenizer, end_id=end_id), "manifest")
    return manifest, read_parts(manifest)
