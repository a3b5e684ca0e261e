"""Token ids as fixed-width bit-packed files with block offsets, written in document order.

A file image is
    b"GDBP" | version u16 | width u16 | ids u64 | first id u64 (ids of its shard before it)
    | ids in a block u32 | blocks u32 | documents u64
    | block offsets u64[blocks + 1], in bytes from the end of the last table
    | document ends u64[documents], in ids | document ids i64[documents] | null flags u8[documents] | blocks
all little-endian. A block holds its ids least significant bit first, `width` bits each, padded to
a byte; a block is read alone, so any range of ids costs only the blocks it touches. Images are
rows of a Parquet table (shard, chunk, first_id, n_ids, image), which any file system that Spark
writes can hold and whose commit survives lost executors; the first four columns repeat the
image's header, so that readers skip images.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import new_path, texts

MAGIC, HEAD = b"GDBP", struct.Struct("<4sHHQQIIQ")
BLOCK_IDS = 4096
CHUNK_IDS = 1 << 18


def width_of(vocab: int) -> int:
    """Bits that hold the ids 0 .. vocab - 1."""
    return max(1, (vocab - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype="<u4")) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return (bits.astype("<u4") << np.arange(width, dtype="<u4")).sum(axis=1, dtype="<u4")


def encode_image(ids: np.ndarray, width: int, block: int = BLOCK_IDS, doc_ids: Sequence[int | None] = (), doc_lens: Sequence[int] = (), first: int = 0) -> bytes:
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} needs more than {width} bits")
    blocks = [pack_bits(ids[k : k + block], width) for k in range(0, len(ids), block)]
    offsets = np.append(0, np.cumsum([len(b) for b in blocks], dtype="<u8")).astype("<u8")
    null = np.array([i is None for i in doc_ids], np.uint8)
    own = np.array([i or 0 for i in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, 2, width, len(ids), first, block, len(blocks), len(doc_ids))
    return b"".join([head, offsets.tobytes(), np.cumsum(doc_lens, dtype="<u8").tobytes(), own.tobytes(), null.tobytes(), *blocks])


def header(image: bytes) -> tuple[int, int, int, int, int, int]:
    """(width, ids, first id, ids in a block, blocks, documents)."""
    magic, version, *rest = HEAD.unpack_from(image)
    if magic != MAGIC or version != 2:
        raise ValueError("not a packed image")
    return tuple(rest)


def decode_image(image: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The ids lo .. hi - 1; only the blocks that hold them are unpacked."""
    width, n, _, block, blocks, docs = header(image)
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.zeros(0, "<u4")
    offsets = np.frombuffer(image, "<u8", blocks + 1, HEAD.size)
    data, begin, last = HEAD.size + 8 * (blocks + 1) + 17 * docs, lo // block, (hi - 1) // block
    got = [unpack_bits(image[data + int(offsets[b]) : data + int(offsets[b + 1])], min(block, n - b * block), width) for b in range(begin, last + 1)]
    return np.concatenate(got)[lo - begin * block : hi - begin * block]


def documents_of(image: bytes) -> tuple[int, list[int | None], np.ndarray]:
    """(first id, document ids, their ends in ids of the image)."""
    _, _, first, _, blocks, docs = header(image)
    at = HEAD.size + 8 * (blocks + 1)
    ends, ids, null = np.frombuffer(image, "<u8", docs, at), np.frombuffer(image, "<i8", docs, at + 8 * docs), np.frombuffer(image, np.uint8, docs, at + 16 * docs)
    return first, [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], ends.astype(np.int64)


def write_packed(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_ids: int = CHUNK_IDS) -> str:
    """Encode every text, append end_id, write the ids in ascending doc_id order; returns the path of the table.

    Rows are dealt by ranges of doc_id and sorted within a range, so shard order is document
    order; null ids come first, rows with the same id go by text. A null text is empty and gives
    the end id alone. A task holds one chunk of about chunk_ids ids, or one document if that is longer, and a group of texts.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "packed")
    width = width_of(max(pieces.load(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1))

    def run(it):
        table, shard = pieces.loaded(tokenizer), TaskContext.get().partitionId()
        chunk, first, ids, lens, data = 0, 0, [], [], []

        def image():
            n = sum(lens)
            return pa.RecordBatch.from_pydict({"shard": [shard], "chunk": [chunk], "first_id": [first], "n_ids": [n], "image": [encode_image(np.concatenate(data), width, BLOCK_IDS, ids, lens, first)]}, schema=shape), n

        for batch in it:
            doc_ids, text = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in pieces.runs(pc.binary_length(text).to_numpy(zero_copy_only=False)):
                got, n, _ = table.encode(text.slice(lo, hi - lo))
                ends = np.cumsum(n + 1)
                own = np.insert(got, np.cumsum(n), end_id)
                cuts = chunks(ends, sum(lens), chunk_ids)
                for a, b in zip([0, *cuts], [*cuts, hi - lo], strict=True):
                    if a == b:  # the last chunk ended with the group
                        continue
                    ids += doc_ids[lo + a : lo + b]
                    lens += (n[a:b] + 1).tolist()
                    data.append(own[ends[a - 1] if a else 0 : ends[b - 1]])
                    if b in cuts:
                        out, held = image()
                        yield out
                        chunk, first, ids, lens, data = chunk + 1, first + held, [], [], []
        if ids:
            yield image()[0]

    shape = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = ordered.mapInArrow(run, "shard int, chunk int, first_id long, n_ids long, image binary")
    out.write.option("compression", "none").parquet(path)
    return path


def chunks(ends: np.ndarray, held: int, chunk_ids: int = CHUNK_IDS) -> list[int]:
    """After how many documents a chunk is full, given where they end and the ids it holds already."""
    out, base = [], -held
    while len(ends):
        k = int(np.searchsorted(ends, base + chunk_ids, side="left"))
        if k >= len(ends):
            break
        out.append(k + 1)
        base = int(ends[k])
    return out


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard. One long for each shard, and there are as many shards as range partitions."""
    rows = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    out, total = {}, 0
    for r in rows:
        out[r["shard"]] = total
        total += r["n"]
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32), shard, chunk."""
    starts = shard_starts(spark, path)

    def run(it):
        for batch in it:
            out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "chunk")}
            for shard, chunk, image in zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "image")), strict=True):
                raw = memoryview(decode_image(image).tobytes())
                first, ids, ends = documents_of(image)
                at = 0
                for i, end in zip(ids, ends.tolist(), strict=True):
                    for k, v in zip(out, (i, starts[shard] + first + at, end - at, zlib.crc32(raw[4 * at : 4 * end]), shard, chunk), strict=True):
                        out[k].append(v)
                    at = end
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return spark.read.parquet(path).select("shard", "chunk", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, chunk int")


def read_ids(spark: SparkSession, path: str, lo: int, hi: int) -> np.ndarray:
    """The ids lo .. hi - 1 of the whole corpus, from the images that hold them only (a reader's window: hi - lo is what comes to the driver)."""
    starts, got = shard_starts(spark, path), []
    for r in spark.read.parquet(path).where(F.expr(" or ".join([f"(shard = {s} and first_id < {hi - b} and first_id + n_ids > {lo - b})" for s, b in starts.items() if b < hi] or ["false"]))).orderBy("shard", "chunk").toLocalIterator():
        at = starts[r["shard"]] + r["first_id"]
        got.append(decode_image(bytes(r["image"]), max(0, lo - at), max(0, hi - at)))
    return np.concatenate(got) if got else np.zeros(0, "<u4")


def pack_corpus(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write_packed, then read_documents of what was written."""
    return read_documents(docs.sparkSession, write_packed(docs, tokenizer, None, end_id, id_col, text_col))
