"""Ranked lexical search: an inverted index in segments of documents, searched with Block-Max WAND.

A segment holds a group of documents, numbered in order of doc_id. A term's postings are cut into
blocks of BLOCK; a block keeps its last document, its maximum impact and where its bytes lie, so
that a search can bound what the block adds to a score, and pass over it, without decompressing it.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, texts

#: Postings of a block.
BLOCK = 128
#: Bytes of text of a segment, about; a longer document is a segment of its own.
SEGMENT = 4 << 20
#: Every so many segments are searched first; their k-th scores are the others' first thresholds.
LEAD = 16
#: Characters of items searched in one pass over the index.
ITEM_CHARS = 4_000_000
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # in UTF-8 the same as the characters outside the ASCII ranges between letters and digits
K = 10

INDEX = "segment long, n_docs int, docs binary, terms binary, counts binary, firsts binary, blocks binary, postings binary"
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("m", "<i8")])
BLOCKS = np.dtype([("first", "<i4"), ("last", "<i4"), ("impact", "<i4"), ("at", "<i8"), ("n", "u1"), ("gap", "u1"), ("tf", "u1")])
WIDTHS = {1: np.dtype("<u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, only A-Z in lower case."""
    return TERM.findall(text.encode().lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def lengths(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents): beginnings of terms, counted on the bytes of whole batches."""

    def run(it):
        own = np.zeros(256, bool)
        own[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
        for batch in it:
            text = batch.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            lo, hi = int(offsets[0]), int(offsets[-1])
            part = own[np.frombuffer(text.buffers()[2], np.uint8, hi - lo, lo)] if hi > lo else np.zeros(0, bool)
            begins = part.copy()
            begins[1:] &= ~part[:-1]
            heads = (offsets[:-1] - lo)[np.diff(offsets) > 0]
            begins[heads] = part[heads]  # a document's first character ends what stood before it
            before = np.insert(np.cumsum(begins), 0, 0)
            n = before[offsets[1:] - lo] - before[offsets[:-1] - lo]
            yield pa.RecordBatch.from_pydict({"n_docs": pa.array([int((n > 0).sum())], pa.int64()), "n_terms": pa.array([int(n.sum())], pa.int64())})

    got = docs.select("text").mapInArrow(run, "n_docs long, n_terms long").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    return got["n"] or 0, got["l"] or 0


# --- the index ----------------------------------------------------------------------------------------


def encode_segment(docs: list[tuple[int | None, str]], n_docs: int, n_terms: int) -> dict | None:
    """The columns of a segment but its number, for (doc_id, text) of its documents; None if no document has a term."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    vocabulary, kept, term, doc, tf = defaultdict(count().__next__), [], array("i"), array("i"), array("q")  # a new term gets the next number
    for doc_id, text in docs:
        counted = Counter(terms_of(text))
        if not counted:
            continue
        term.extend(map(vocabulary.__getitem__, counted))
        tf.extend(counted.values())
        doc.extend([len(kept)] * len(counted))
        kept.append((doc_id or 0, doc_id is None, 25 + (75 * sum(counted.values()) * n_docs) // n_terms))
    if not kept:
        return None
    names = sorted(vocabulary)
    place = np.empty(len(names), np.int64)
    place[[vocabulary[t] for t in names]] = np.arange(len(names))
    meta = np.array(kept, DOC)
    term, doc, tf = place[np.frombuffer(term, np.int32)], np.frombuffer(doc, np.int32), np.frombuffer(tf, np.int64)
    order = np.argsort(term, kind="stable")  # documents stay in order within a term
    term, doc, tf = term[order], doc[order], tf[order]
    counts = np.bincount(term, minlength=len(names)).astype("<i4")
    starts = np.cumsum(counts) - counts
    impact = impacts(tf, meta["m"][doc])
    within = np.arange(len(doc)) - starts[term]
    heads = np.flatnonzero(within % BLOCK == 0)
    ends = np.append(heads[1:], len(doc))
    gaps = np.diff(doc, prepend=-1)
    gaps[heads] = doc[heads] - np.where(within[heads] == 0, -1, doc[heads - 1])  # a block goes on from the last document of the one before it
    blocks = np.zeros(len(heads), BLOCKS)
    blocks["first"], blocks["last"], blocks["n"] = doc[heads], doc[ends - 1], ends - heads
    blocks["impact"] = np.maximum.reduceat(impact, heads)
    for name, values in (("gap", gaps), ("tf", tf)):
        top = np.maximum.reduceat(values, heads)
        blocks[name] = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))
    size = blocks["n"].astype(np.int64) * (blocks["gap"].astype(np.int64) + blocks["tf"])
    blocks["at"] = np.cumsum(size) - size
    data, block = np.zeros(int(size.sum()), np.uint8), np.repeat(np.arange(len(heads)), ends - heads)
    at, inside = blocks["at"][block], np.arange(len(doc)) - heads[block]
    wide, n = blocks["gap"][block].astype(np.int64), blocks["n"][block].astype(np.int64)
    for values, width, begin in ((gaps, wide, at), (tf, blocks["tf"][block].astype(np.int64), at + n * wide)):
        for k in range(int(width.max())):  # the k-th lowest byte of every value that has one
            has = width > k
            data[(begin + inside * width + k)[has]] = (values[has] >> 8 * k) & 255
    firsts = np.append(0, np.cumsum((counts + BLOCK - 1) // BLOCK)).astype("<i4")
    return {"n_docs": len(kept), "docs": meta.tobytes(), "terms": b"\n".join(names), "counts": counts.tobytes(), "firsts": firsts.tobytes(), "blocks": blocks.tobytes(), "postings": data.tobytes()}


class Index:
    """(table of INDEX, documents with a term, terms of all documents)"""

    def __init__(self, table: DataFrame, n_docs: int, n_terms: int):
        self.table, self.n_docs, self.n_terms = table, n_docs, n_terms


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> Index:
    """The index of every whole text, a row per segment, written to the shared folder.

    Documents stay where they are read: a segment is what one task reads next, so nothing is shuffled
    and a segment lost with an executor is made again from its input. A null text has no term.
    """
    rows = texts(docs, id_col, text_col)
    n_docs, n_terms = lengths(rows)
    kinds = pa.schema([("segment", pa.int64()), ("n_docs", pa.int32()), *[(c, pa.binary()) for c in ("docs", "terms", "counts", "firsts", "blocks", "postings")]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def made():
            got = encode_segment(held, n_docs, n_terms)
            return [] if got is None else [pa.RecordBatch.from_pydict({"segment": [number]} | {k: [v] for k, v in got.items()}, schema=kinds)]

        for batch in it:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc_id, text.as_py()))
                size += len(held[-1][1])
                if size >= segment:
                    yield from made()
                    number, held, size = number + 1, [], 0
        if held:
            yield from made()

    return Index(cut(rows.mapInArrow(run, INDEX), "segments"), n_docs, n_terms)


def document_counts(index: Index, wanted: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the wanted terms, by the dictionaries of all segments."""
    spark = index.table.sparkSession
    sent = spark.sparkContext.broadcast(wanted)

    def run(it):
        for batch in it:
            found = Counter()
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here, n = terms.split(b"\n"), np.frombuffer(counts, "<i4")
                for k, t in enumerate(here):
                    if t in sent.value:
                        found[t] += int(n[k])
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    total = index.table.select("terms", "counts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return {bytes(r["term"]): r["df"] for r in total.collect()}  # at most the wanted terms


# --- the search ---------------------------------------------------------------------------------------


class Segment:
    """One segment, its postings decompressed a block at a time, each block once."""

    def __init__(self, docs: bytes, terms: bytes, counts: bytes, firsts: bytes, blocks: bytes, postings: bytes):
        self.docs = np.frombuffer(docs, DOC)
        self.place = {t: k for k, t in enumerate(terms.split(b"\n"))}
        self.firsts, self.blocks, self.postings = np.frombuffer(firsts, "<i4"), np.frombuffer(blocks, BLOCKS), postings
        self.first, self.last, self.impact = (self.blocks[c].astype(np.int64) for c in ("first", "last", "impact"))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        if b not in self.open:
            _, _, _, at, n, gap, tf = self.blocks[b].item()
            docs = np.cumsum(np.frombuffer(self.postings, WIDTHS[gap], n, at), dtype=np.int64) + (-1 if first else self.last[b - 1])
            self.open[b] = docs, impacts(np.frombuffer(self.postings, WIDTHS[tf], n, at + n * gap), self.docs["m"][docs])
        return self.open[b]

    def search(self, query: list[tuple[bytes, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k highest scores above 0 and not below `least`, equal scores by document; query: (term, weight times repeats).

        The first and last documents of all terms' blocks cut the documents into ranges. Within a
        range every term stays in one block or in none, so the weighted maximum impacts of these blocks, found by moving
        pointers over the blocks' ends only, bound each score in it. Ranges go from the highest bound
        down, a growing number at a time, until the next bound is below the k-th score; only their
        blocks are decompressed.
        """
        lists = [(self.firsts[p], self.firsts[p + 1], w) for t, w in query if w > 0 and (p := self.place.get(t)) is not None]
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not lists:
            return nothing
        ends = np.unique(np.concatenate([x for a, b, _ in lists for x in (self.first[a:b] - 1, self.last[a:b])]))
        bound, pointers = np.zeros(len(ends), np.int64), []
        for a, b, w in lists:  # shallow moves: the block that holds each range, -1 if none does
            at = np.searchsorted(self.last[a:b], ends) + a
            at[at == b] = a
            at[(self.first[at] > ends) | (self.last[at] < ends)] = -1
            bound += np.where(at < 0, 0, w * self.impact[at])
            pointers.append(at)
        order = np.argsort(-bound, kind="stable")
        found, scores, done, step = *nothing, 0, 1
        while done < len(order) and bound[order[done]] >= max(least, 1):
            chosen = order[done : done + step]
            chosen = chosen[bound[chosen] >= max(least, 1)]
            take = np.zeros(len(ends) + 1, bool)
            take[chosen] = True
            total = np.zeros(len(self.docs), np.int64)
            for (a, _, w), at in zip(lists, pointers, strict=True):
                for block in {*at[chosen].tolist()} - {-1}:
                    docs, impact = self.block(block, block == a)
                    total[docs] += w * impact
            hit = np.flatnonzero(total)
            hit = hit[take[np.searchsorted(ends, hit)]]  # outside the ranges sums are not whole
            found, scores = np.append(found, hit), np.append(scores, total[hit])
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
            if len(found) == k:
                least = max(least, int(scores[-1]))
            done, step = done + step, 2 * step
        stays = scores >= least
        return found[stays], scores[stays]


def blocks_of_items(items: DataFrame, most: int = ITEM_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """Distinct (item_id, text), about `most` characters at a time."""
    held, size = [], 0
    for r in items.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(index: Index, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text", lead: int = LEAD) -> DataFrame:
    """item_id, rank int, doc_id, score long: each item's k documents of highest score above 0, equal scores by ascending doc_id.

    Rows equal in item_id and text are one item; items that share an id only are ranked each by itself. Items
    without a term, and terms that no document holds, find nothing. Rows of one doc_id are documents of their own; null ids come
    last among equal scores. Items go in blocks of ITEM_CHARS characters, which bounds what is broadcast. One
    segment in `lead` is searched first, without a threshold; the k-th scores found there are where the others start.
    """
    spark = index.table.sparkSession
    rows = items.select(items[id_col].cast("long").alias("item_id"), F.coalesce(items[text_col], F.lit("")).alias("text")).distinct()
    best = [spark.createDataFrame([], "item long, item_id long, doc_id long, score long")]
    base = 0
    for block in blocks_of_items(rows):
        counted = [(i, Counter(terms_of(text))) for i, text in block]
        df = document_counts(index, {t for _, c in counted for t in c})
        w = {t: weight(index.n_docs, n) for t, n in df.items()}
        queries = [(base + at, i, [(t, w[t] * n) for t, n in c.items() if t in w]) for at, (i, c) in enumerate(counted)]
        base += len(block)
        sent = spark.sparkContext.broadcast(queries)
        first = cut(top(found_in(index.table.where(F.pmod(F.xxhash64("segment"), F.lit(lead)) == 0), sent, k, {}), k), "lead")
        known = first.groupBy("item").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k)
        least = {r["item"]: r["s"] for r in known.collect()}  # a number for each item of the block
        best += [first, found_in(index.table.where(F.pmod(F.xxhash64("segment"), F.lit(lead)) != 0), sent, k, least)]
    together = best[0]
    for b in best[1:]:
        together = together.unionAll(b.select("item", "item_id", "doc_id", "score"))
    return top(together, k).select("item_id", "rank", "doc_id", "score")


def found_in(table: DataFrame, sent, k: int, least: dict[int, int]) -> DataFrame:
    columns = ("docs", "terms", "counts", "firsts", "blocks", "postings")

    def run(it):
        for batch in it:
            for n in range(batch.num_rows):
                segment, out = Segment(*(batch.column(c)[n].as_py() for c in columns)), {c: [] for c in ("item", "item_id", "doc_id", "score")}
                for item, item_id, query in sent.value:
                    docs, scores = segment.search(query, k, least.get(item, 0))
                    out["item"] += [item] * len(docs)
                    out["item_id"] += [item_id] * len(docs)
                    out["doc_id"] += [None if null else i for i, null, _ in segment.docs[docs].tolist()]
                    out["score"] += scores.tolist()
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return table.select(*columns).mapInArrow(run, "item long, item_id long, doc_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with rank. A segment gives k rows at most, and Spark cuts each task's rows to k before it shuffles them."""
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item", "item_id", "rank", "doc_id", "score")


SQL = r"""
WITH given AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
dterms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
iterms AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM given),
freq AS (SELECT doc_id, term, count(*) AS tf FROM dterms GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM freq GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
norm AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM len, total),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM freq, total GROUP BY term),
query AS (SELECT item_id, term, count(*) AS repeats FROM iterms GROUP BY ALL),
scored AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM query JOIN weights USING (term) JOIN freq USING (term) JOIN norm USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
