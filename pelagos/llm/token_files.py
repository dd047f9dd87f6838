"""Token-id files: one zstandard frame per document and a trailing seek table with a checksum per frame.

A file holds the documents' frames in order, a skippable frame with the documents' ids (an Arrow
stream) and, as another skippable frame, the seek table of the public zstd seekable format: for each frame
its compressed size, its plain size and the low 32 bits of the XXH64 of its plain bytes. A reader takes the
footer, the table and the ids, and decompresses only the frames of the documents asked for.

Defined cases: a null or empty text is the end id alone; null ids come first; repeated ids are separate
documents, in the order of their texts; an empty table writes no file and reads back as no rows; columns
other than the id and the text are not read. A file is written under a temporary name and then renamed, so a
task that runs again leaves the same file.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table
from .tokens import encoder

TOKENIZER, END_ID, LEVEL = "word_bpe_49k.json", 1, 3
ROLL_BYTES = 64 << 20
# Fixed values of the zstd frame and seekable formats.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_FOOTER = struct.Struct("<IBI")


class TokenFileWriter:
    """Frames go to ``out`` one by one; ``close`` adds the ids and the seek table."""

    def __init__(self, out: BinaryIO, width: int = 2, level: int = LEVEL):
        self.out, self.width = out, width
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list = []
        self.size = 0
        self.n_tokens = 0

    def add(self, doc_id, ids: bytes) -> None:
        """``ids`` as 32-bit little-endian; stored in ``width`` bytes each."""
        plain = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        packed = self.zstd.compress(plain)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.out.write(packed)
        self.size += len(packed)
        self.n_tokens += len(ids) // 4

    def close(self) -> None:
        sink = io.BytesIO()
        batch = pa.RecordBatch.from_arrays([pa.array(self.ids)], schema=pa.schema([("doc_id", pa.array(self.ids).type)], metadata={"width": str(self.width)}))
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        ids = sink.getvalue()
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        rows = np.array([*self.entries, (len(ids) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)], dtype=_ENTRY).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(rows) + _FOOTER.size) + rows + _FOOTER.pack(len(self.entries) + 1, 0x80, SEEKABLE))


class TokenFile:
    """Random access to an open, seekable file."""

    def __init__(self, f: BinaryIO):
        self.f = f
        size = f.seek(0, 2)
        f.seek(size - _FOOTER.size)
        n, kind, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != SEEKABLE or not kind & 0x80:
            raise ValueError("not a seekable token file")
        f.seek(size - _FOOTER.size - n * _ENTRY.itemsize)
        rows = np.frombuffer(f.read(n * _ENTRY.itemsize), _ENTRY)
        self.entries = rows[:-1]
        self.at = np.concatenate([[0], np.cumsum(rows["packed"].astype(np.int64))])
        f.seek(int(self.at[n - 1]) + 8)
        ids = pa.ipc.open_stream(f.read(int(rows["packed"][-1]) - 8)).read_all()
        self.width = int(ids.schema.metadata[b"width"])
        self.doc_ids = ids.column(0)
        self.zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def read(self, k: int) -> np.ndarray:
        """The ids of document ``k``; raises if its bytes are damaged."""
        self.f.seek(int(self.at[k]))
        plain = self.zstd.decompress(self.f.read(int(self.entries["packed"][k])))
        if len(plain) != self.entries["plain"][k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"checksum of frame {k} does not hold")
        return np.frombuffer(plain, f"<u{self.width}")

    def find(self, doc_id) -> list[int]:
        return [k for k, x in enumerate(self.doc_ids.to_pylist()) if x == doc_id]


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``docs`` in ascending doc_id order below ``path``; returns the manifest, a row per file.

    ``path`` is a URI that the executors can write to. Range partitions keep the order without a global sort in one task.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        enc = encoder(tokenizer)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, roll, rows = TaskContext.get().partitionId(), 0, []
        writer = None

        def finish() -> None:
            writer.close()
            writer.out.close()
            fs.move(hidden, final)
            rows.append((part, roll, final_uri, len(writer.ids), writer.n_tokens))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if writer is None:
                    name = f"part-{part:06d}-{roll:04d}.ids.zst"
                    final, final_uri, hidden = f"{root}/{name}", f"{path}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
                    writer = TokenFileWriter(fs.open_output_stream(hidden), width)
                writer.add(doc_id, enc.encode(text) + end)
                if writer.size >= roll_bytes:
                    finish()
                    writer, roll = None, roll + 1
        if writer is not None:
            finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "roll", "file", "n_docs", "n_tokens"])

    return materialise(dealt.mapInArrow(run, "part long, roll long, file string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files alone."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("start", F.coalesce(before, F.lit(0))).select("file", "start")  # a row per file
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = pyarrow.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(name) as f:
                    file = TokenFile(f)
                    for at in range(0, len(file), 1024):
                        starts, sizes, crcs, kept = [], [], [], []
                        for k in range(at, min(at + 1024, len(file))):
                            ids = file.read(k).astype("<u4").tobytes()
                            starts.append(start)
                            sizes.append(len(ids) // 4)
                            crcs.append(zlib.crc32(ids))
                            start += len(ids) // 4
                            if with_ids:
                                kept.append(ids)
                        cols = [file.doc_ids.slice(at, 1024).combine_chunks(), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols.append(pa.array(kept, pa.binary()))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return files.repartition(n, "file").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_documents(spark: SparkSession, files: Iterable[str], doc_id) -> list[np.ndarray]:
    """The ids of the documents with this id, reading only seek tables and their frames."""
    found = []
    for uri in files:
        fs, name = pyarrow.fs.FileSystem.from_uri(uri)
        with fs.open_input_file(name) as f:
            file = TokenFile(f)
            found += [file.read(k) for k in file.find(doc_id)]
    return found


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, read back from the files."""
    path = f"{shared_dir(spark)}/pelagos/ids-{uuid.uuid4().hex}"
    if "://" not in path:
        path = f"file:{'' if path.startswith('file:') else '//'}{path.removeprefix('file:')}"
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, path)
    return read_token_files(manifest, docs.schema["doc_id"].dataType.simpleString())
