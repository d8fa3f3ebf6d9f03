"""Token ids in files of independent Zstandard frames with a seek table at the end.

The layout is the public seekable format: one frame per document (a very long one has several), each with its own content
checksum; then a skippable frame with the ids of the documents; then the seek table, a skippable frame of each frame's
compressed size, plain size and checksum. A reader fetches the end of a file and then only the frames it is asked for.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_dir
from .common import body, joined_id, split_id, written
from .tokens import encoder, tokenizer_path

END_ID = 2
#: Ids of one frame at most.
FRAME_IDS = 1 << 20
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("frames", "<u4")])
MANIFEST = "part int, file string, n_docs long, n_ids long, n_bytes long"


def check(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class Writer:
    """Appends documents to an open file and ends it with index and seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        first = len(self.entries)
        for at in range(0, max(len(ids), 1), 4 * FRAME_IDS):
            plain = ids[at : at + 4 * FRAME_IDS]
            frame = self.zstd.compress(plain)
            self.out.write(frame)
            self.entries.append((len(frame), len(plain), check(plain)))
        self.documents.append((doc_id or 0, doc_id is not None, first, len(self.entries) - first))
        self.n_ids += len(ids) // 4

    def end(self) -> None:
        index = np.array(self.documents, DOCUMENT).tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append((len(index) + 8, 0, check(b"")))
        table = np.array(self.entries, ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Documents of one file; only the end of the file and the frames asked for are read."""

    def __init__(self, url: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(url)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{url} has no seek table with checksums")
        self.entries = np.frombuffer(self._read(size - 9 - count * ENTRY.itemsize, count * ENTRY.itemsize), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.documents = np.frombuffer(self._read(int(self.starts[-2]) + 8, int(self.entries["packed"][-1]) - 8), DOCUMENT)
        self.zstd = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, position: int) -> bytes:
        """The ids of the file's document at ``position``."""
        d = self.documents[position]
        return b"".join(self._frame(f) for f in range(int(d["frame"]), int(d["frame"]) + int(d["frames"])))

    def _frame(self, f: int) -> bytes:
        plain = self.zstd.decompress(self._read(int(self.starts[f]), int(self.entries["packed"][f])))
        if len(plain) != self.entries["plain"][f] or check(plain) != self.entries["check"][f]:
            raise ValueError(f"frame {f} of {self.path} is damaged")
        return plain

    def positions(self, doc_id: int) -> np.ndarray:
        return np.flatnonzero((self.documents["doc_id"] == doc_id) & (self.documents["known"] == 1))

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Encode every whole text, end it with ``end_id``, and write files whose documents ascend by doc_id, file after file.

    Returns the manifest: part (the order of files), file, n_docs, n_ids, n_bytes. A task writes its file under another name
    and renames it when complete, so a repeated task replaces it whole. Null ids come first; rows with one id are ordered by
    a hash of their texts, and dealt to files by both. Null and empty texts have the end id alone. An empty table has no files.
    """
    path = path or tokenizer_path()
    folder = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all, end = encoder(path).encode_all, array("I", [end_id]).tobytes()
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name, temporary = f"{at}/ids-{part:06d}.zst", f"{at}/_writing-{part:06d}-{attempt}"
        with fs.open_output_stream(temporary) as out:
            file = Writer(out)
            for rows in chain([first], batches):
                for doc_id, known, ids in zip(rows["doc_id"], rows["known"], encode_all(rows["text"])):
                    file.add(int(doc_id) if known else None, ids + end)
            file.end()
            n_bytes = out.tell()
        fs.move(temporary, name)
        yield pd.DataFrame([(part, f"{folder}/ids-{part:06d}.zst", len(file.documents), file.n_ids, n_bytes)], columns=["part", "file", "n_docs", "n_ids", "n_bytes"])

    text = body(docs)
    rows = docs.select(*split_id(docs), text.alias("text"), F.xxhash64(text).alias("tie"))
    order = ["known", "doc_id", "tie"]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "known", "text").mapInPandas(store, MANIFEST), "manifest")


def read(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids) from the files of a manifest.

    ``doc_ids`` picks documents: only their frames are decompressed.
    """
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, base in zip(batch["file"], batch["base"]):
                reader = Reader(file)
                d = reader.documents
                plain = np.concatenate([[0], np.cumsum(reader.entries["plain"], dtype=np.int64)]) // 4
                ask = range(len(d)) if wanted is None else np.flatnonzero(np.isin(d["doc_id"], wanted) & (d["known"] == 1))
                rows = []
                for k in ask:
                    ids = reader.ids(k)
                    rows.append((int(d["doc_id"][k]), bool(d["known"][k]), int(base + plain[d["frame"][k]]), len(ids) // 4, zlib.crc32(ids)) + ((np.frombuffer(ids, "<u4").astype("int32"),) if with_ids else ()))
                    if len(rows) == 1000 or with_ids:
                        yield _frame(rows, with_ids)
                        rows = []
                reader.close()
                if rows:
                    yield _frame(rows, with_ids)

    # One row per file, so this window and the deal that follows are over a short table.
    based = manifest.select("file", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined_id(based.repartition(spread).mapInPandas(fetch, "doc_id long, known boolean, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids))


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "known", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the files and read every document back."""
    return read(write(docs, folder or fresh_dir(docs.sparkSession, "token-files")))
