"""Token counts without ids: pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies, and summed.

Each step is spread over all tasks:

1. texts are cut into pre-tokens. A group of about 16 MB of texts numbers its distinct pre-tokens, and a document's
   frequencies are pairs (number, times), so that a pre-token is spelt once per group and not once per document;
2. the pre-tokens of all groups are dealt and sorted by spelling, so that equal ones follow each other: the library
   encodes the first, and the rows (group, number) of the others take its count;
3. each group's documents meet its counts and sum times * pieces.

A pre-token, however frequent, has one row per group at most, and a group's tables are bounded by its texts. The texts
are cut once for each of the two sides, which is cheaper than a table of the frequencies in between.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import pieces
from .common import texts


def groups_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(doc_id, text, bytes of each text) of successive groups of about `most` bytes, or of one longer text."""
    ids, text, sizes, held = [], [], [], 0
    for batch in batches:
        n_bytes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in pieces.runs(n_bytes, most):
            ids.append(batch.column("doc_id").slice(lo, hi - lo))
            text.append(batch.column("text").slice(lo, hi - lo))
            sizes.append(n_bytes[lo:hi])
            held += int(n_bytes[lo:hi].sum())
            if held >= most:
                yield pa.concat_arrays(ids), pa.concat_arrays(text), np.concatenate(sizes)
                ids, text, sizes, held = [], [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(text), np.concatenate(sizes)


def name_of(k: int, parts: pa.Array) -> int:
    """A group's name: its task, its place there and its pre-tokens in order. Numbers of another order have another name."""
    digest = blake2b(f"{TaskContext.get().partitionId()} {k} ".encode(), digest_size=8)
    digest.update("\x01".join(parts.to_pylist()).encode())
    return int.from_bytes(digest.digest(), "little", signed=True)


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers byte by byte, all lowest bytes first: small ones leave runs of zeros, which shuffles compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def frequencies(docs: DataFrame, tokenizer: str, group_bytes: int = pieces.GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group, doc_id, n_bytes, steps, times), a row per document: its pre-tokens' numbers as steps from one to the next, and how often each comes (both as planes)."""

    def run(it):
        table = pieces.loaded(tokenizer)
        for k, (ids, text, n_bytes) in enumerate(groups_of(it, group_bytes)):
            parts, at, times, ends = table.frequencies(text)
            starts = np.append(0, ends[:-1])
            steps = [planes(np.diff(at[lo:hi], prepend=0)) for lo, hi in zip(starts, ends, strict=True)]
            often = [planes(times[lo:hi]) for lo, hi in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name_of(k, parts))), ids, pa.array(n_bytes), pa.array(steps, pa.binary()), pa.array(often, pa.binary())], names=["group", "doc_id", "n_bytes", "steps", "times"])

    return texts(docs, id_col, text_col).mapInArrow(run, "group long, doc_id long, n_bytes long, steps binary, times binary")


def distinct_parts(docs: DataFrame, tokenizer: str, group_bytes: int = pieces.GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(of, number, part): the distinct pre-tokens of each group."""

    def run(it):
        table = pieces.loaded(tokenizer)
        for k, (_, text, _) in enumerate(groups_of(it, group_bytes)):
            parts = table.frequencies(text)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), name_of(k, parts))), pa.array(np.arange(len(parts), dtype=np.int32)), parts], names=["of", "number", "part"])

    return texts(docs, id_col, text_col).mapInArrow(run, "of long, number int, part string")


def counted(parts: DataFrame, tokenizer: str) -> DataFrame:
    """(of, number, n_pieces) of rows (of, number, part): each distinct pre-token is encoded once, all its rows get the count."""

    def run(it):
        table = pieces.loaded(tokenizer)
        last, last_n = None, 0
        for batch in it:
            coded = batch.column("part").dictionary_encode()
            names = coded.dictionary
            if not len(names):
                continue
            known = int(names[0].as_py() == last)  # goes on from the batch before
            n = np.append(np.full(known, last_n), table.sizes(names.slice(known)))
            last, last_n = names[-1].as_py(), n[-1]
            yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("number"), pa.array(n[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int32))], names=["of", "number", "n_pieces"])

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "of long, number int, n_pieces int")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, group_bytes: int = pieces.GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_parts (pre-token occurrences).

    tokenizer: path of a .json file of the tokenizers library; special strings inside a text
    count as that library reads them. A null text counts as empty: 0 tokens. A null doc_id stays
    null. Repeated rows each give a row; an empty table gives none; a text of any length is one
    document of one group. docs must give the same rows in the same order when read again, as a
    table does: a group that reads otherwise finds no counts, and that raises.
    """
    known = counted(distinct_parts(docs, tokenizer, group_bytes, id_col, text_col), tokenizer)

    def run(own: pa.Table, pieces_of: pa.Table) -> pa.Table:
        if len(own) and not len(pieces_of):
            raise ValueError("the documents were read in another order the second time: write them to a table first")
        number = pieces_of.column("number").to_numpy()
        size = np.zeros(len(number), np.int64)
        size[number] = pieces_of.column("n_pieces").to_numpy()
        n, m = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for k, (steps, times) in enumerate(zip(own.column("steps").to_pylist(), own.column("times").to_pylist(), strict=True)):
            times = of_planes(times)
            n[k], m[k] = size[np.cumsum(of_planes(steps))] @ times, times.sum()
        n_bytes = own.column("n_bytes").to_numpy()
        return pa.table([own.column("doc_id"), n_bytes, n, n > limit, np.where(n_bytes > 0, m, 0)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_parts"])

    rows = frequencies(docs, tokenizer, group_bytes, id_col, text_col)
    return rows.groupBy("group").cogroup(known.groupBy("of")).applyInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_parts long")
