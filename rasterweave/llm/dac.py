"""Token files of directly addressable codes.

Each id is split into chunks of 8 bits, lowest first. Level 0 holds every id's
first chunk; a bitmap says which ids go on, and level k + 1 holds the next chunk
of just those, in order. A directory with the number of set bits before every
512th bit gives the place of an id's next chunk by one lookup and one short
count, so any token is read without decoding others.

File layout, little-endian: ``DAC1``, u32 documents, u64 tokens, u32 levels;
i64 doc ids; u8 null marks; u64 first token of each document and the end; per
level: u64 chunks, the chunks, the bitmap in bytes, the u32 directory.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import make_folder, materialise, prepare, scratch, sized_join
from .tokens import encoder as text_encoder

MAGIC, BLOCK = b"DAC1", 512


def encode_file(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.uint64))]).astype("<u8")
    levels, rest = [], ids
    while len(rest) or not levels:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32))])
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<IQI", len(doc_ids), len(ids), len(levels))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head, known.tobytes(), null.tobytes(), starts.tobytes(), *levels])


class DacFile:
    """Reads tokens of one file from its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n, levels = struct.unpack_from("<IQI", data, 4)
        at = 20
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.null = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs).astype(bool)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + docs).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at := at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at := at + n)
            ranks = np.frombuffer(data, "<u4", blocks + 1, at := at + len(bits))
            at += 4 * (blocks + 1)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """The i-th token of the file, touching one entry of each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            first = block * BLOCK // 8
            before = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(bits[i >> 3] & (1 << (i & 7)) - 1).bit_count()
            i, shift = int(ranks[block]) + before, shift + 8
        return value

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Tokens begin..end-1, each level read as one range found by rank."""
        return self._range(0, begin, end)

    def _range(self, level: int, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.zeros(0, np.uint32)
        chunks, bits, ranks = self.levels[level]
        out = chunks[begin:end].astype(np.uint32)
        more = np.unpackbits(bits[begin >> 3 : -(-end // 8)], bitorder="little")[begin & 7 : (begin & 7) + end - begin].astype(bool)
        if more.any():
            block = begin // BLOCK
            first = block * BLOCK // 8
            low = int(ranks[block]) + int(np.bitwise_count(bits[first : begin >> 3]).sum()) + int(bits[begin >> 3] & (1 << (begin & 7)) - 1).bit_count()
            out[more] |= self._range(level + 1, low, low + int(more.sum())) << 8
        return out


def _writer(folder: str, end_id: int, tokenizer: str | None, file_tokens: int):
    def write(batches):
        import pandas as pd
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        context, files = TaskContext.get(), 0
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        encoder = text_encoder(tokenizer)
        docs, lengths, parts, total = [], [], [], 0

        def flush():
            nonlocal files, total
            name = f"tokens-{context.partitionId():06d}-{files:05d}.dac"
            partial = f"{root}/_{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(partial) as out:
                out.write(encode_file(docs, lengths, np.concatenate(parts)))
            fs.move(partial, f"{root}/{name}")
            row = pd.DataFrame({"file": [name], "n_docs": [len(docs)], "n_tokens": [total]})
            docs.clear(), lengths.clear(), parts.clear()
            files, total = files + 1, 0
            return row

        for batch in batches:
            own = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for at, ids, sizes in encoder.batches(batch["text"], end_id):
                begin = 0
                while begin < len(sizes):
                    # a file ends after the document that fills it
                    many = int(np.searchsorted(np.cumsum(sizes[begin:]), file_tokens - total)) + 1
                    some = sizes[begin : begin + many]
                    docs += own[at + begin : at + begin + len(some)]
                    lengths += some.tolist()
                    parts.append(ids[: some.sum()])
                    ids = ids[some.sum() :]
                    total += int(some.sum())
                    begin += len(some)
                    if total >= file_tokens:
                        yield flush()
        if docs:
            yield flush()

    return write


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None, file_tokens: int = 1_000_000) -> DataFrame:
    """Encode whole texts into files below ``folder`` in ascending doc_id order;
    returns the manifest (file, n_docs, n_tokens), file names in that order.

    Null or empty text is the end id alone; null ids come first; repeated ids
    keep all their rows, ordered by text. Other columns are not read. A file
    ends after the document that brings it to ``file_tokens``. A task that runs again writes the same
    names, moved into place when complete. ``folder`` is a URI that pyarrow opens
    (file, hdfs, s3, gs) and all executors share. An empty table gives an empty folder and an empty manifest.
    """
    prepare(docs.sparkSession)
    make_folder(docs.sparkSession, folder)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # rows of one id, or of none, are dealt by how their texts begin
    d = d.withColumn("_begin", F.left("text", F.lit(64))).repartitionByRange("doc_id", "_begin").sortWithinPartitions("doc_id", "text").drop("_begin")
    return materialise(d.mapInPandas(_writer(folder, end_id, tokenizer, file_tokens), "file string, n_docs long, n_tokens long"), "manifest")


def read_token_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; no rows
    where an empty table was written."""
    prepare(spark)

    def read(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                f = DacFile(content)
                sizes = np.diff(f.starts)
                whole = memoryview(f.tokens(0, f.n).astype("<u4").tobytes())
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(f.starts[:-1].tolist(), f.starts[1:].tolist())]
                yield pd.DataFrame({"file": name, "doc_id": pd.array(f.doc_ids, dtype="Int64").copy() if not f.null.any() else pd.array([None if n else int(i) for i, n in zip(f.doc_ids, f.null)], dtype="Int64"), "local": f.starts[:-1], "n_tokens": sizes, "ids_crc32": crc})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.dac").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.mapInPandas(read, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    # files are numbered within their task: sums of tasks, one row each, and within a task
    parts = manifest.select("file", "n_tokens", F.split("file", "-")[1].alias("part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = parts.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("tasks"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "part", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("files"))
    bases = parts.join(tasks, "part").select("file", (F.col("tasks") + F.col("files")).alias("base"))
    bases = materialise(bases, "token-bases")
    return sized_join(rows, bases, "file", "inner").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark, sf_dir):
    folder = scratch(spark, "token-files")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder, manifest)
