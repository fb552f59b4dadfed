"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds a run of documents in ascending ``doc_id`` order. Layout:
  * one zstandard frame per document (content checksum on) with its ids, little-endian, 2 bytes wide if the
    vocabulary allows it, else 4;
  * a skippable frame (magic 0x184D2A50) with the width and the document ids (8 bytes each, and a byte per document
    that is 1 for a null id);
  * a skippable frame (magic 0x184D2A5E), the seek table of the public seekable format: for each document frame its
    compressed size, its size and the low 32 bits of the XXH64 of its content; last the number of frames, a
    descriptor byte 0x80 (checksums) and 0x8F92EAB1.
Any zstandard decoder reads such a file as the ids of all documents; a reader with the table opens single documents.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage, shared_folder

from .common import local_path, slices, texts
from .tokens import encoder

END_ID = 2
_DIRECTORY, _TABLE, _END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LEVEL = 3


def _open(uri: str, mode: str):
    import pyarrow.fs
    fs, path = pyarrow.fs.FileSystem.from_uri(local_path(uri) or uri)
    return fs.open_output_stream(path, compression=None) if mode == "w" else fs.open_input_file(path)


class Writer:
    """Appends documents; ``close`` writes the directory and the seek table."""

    def __init__(self, out, width: int, level: int = LEVEL):
        import zstandard
        self.out, self.width, self.ids, self.entries, self.tokens = out, width, [], [], 0
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash
        raw = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        frame = self.compress(raw)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.tokens += len(raw) // self.width

    def close(self) -> None:
        ids = np.asarray([x or 0 for x in self.ids], "<i8").tobytes() + bytes(x is None for x in self.ids)
        body = struct.pack("<II", self.width, len(self.ids)) + ids
        self.out.write(struct.pack("<II", _DIRECTORY, len(body)) + body)
        body = np.asarray(self.entries, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.entries), 0x80, _END)
        self.out.write(struct.pack("<II", _TABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Reads single documents of a file: two small reads for the tables, one per document."""

    def __init__(self, file):
        import zstandard
        self.file, self.decompress = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _END or flags != 0x80:
            raise ValueError("no seek table")
        table = size - 9 - 12 * n - 8
        self.entries = np.frombuffer(self._at(table + 8, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])]).astype(np.int64)
        body = self._at(int(self.starts[-1]) + 8, table - int(self.starts[-1]) - 8)
        self.width, n_ids = struct.unpack_from("<II", body)
        ids = np.frombuffer(body, "<i8", n_ids, 8).tolist()
        self.doc_ids = [None if null else x for x, null in zip(ids, body[8 + 8 * n_ids:])]

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; a damaged frame raises."""
        import xxhash
        raw = self.decompress(self._at(int(self.starts[k]), int(self.entries[k, 0])))
        if len(raw) != self.entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} fails its checksum")
        return np.frombuffer(raw, f"<u{self.width}")


def write_frames(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes all documents to files in ``folder`` and returns one row per file: part, path, n_docs, n_tokens.

    Documents are range-partitioned and sorted by ``doc_id`` (null ids first; repeated ids in order of their text
    hash), each task streams one file. A file of a lost or repeated attempt has another name and is in no manifest.
    Null and empty texts hold the end id alone; other columns are ignored; an empty table gives no documents.
    """
    def write(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end, writer = np.asarray([end_id], "<u4").tobytes(), None
        for batch in slices(batches):
            if writer is None:
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                writer = Writer(_open(path, "w"), width)
            for doc, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                writer.add(doc, raw + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.ids)], "n_tokens": [writer.tokens]})

    path = local_path(folder)
    if path:
        import os
        os.makedirs(path, exist_ok=True)
    rows = texts(docs).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
    return cut_lineage(rows.select("doc_id", "text").mapInArrow(write, "part long, path string, n_docs long, n_tokens long"))


def read_frames(manifest: DataFrame) -> DataFrame:
    """Every document of the files of a manifest: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    import zlib

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with _open(path, "r") as file:
                    reader, rows = Reader(file), []
                    for k, doc in enumerate(reader.doc_ids):
                        ids = reader.ids(k)
                        rows.append((doc, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per file; the running total goes over these rows only.
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).select("path", "base")
    files = based.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_folder(spark) -> str:
    """A new folder for token files in the folder that all executors see."""
    return f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
