"""Repeated byte strings across documents by pruned distributed prefix doubling (25 -> 50 bytes).

Prefix doubling ranks every position by its first h bytes and doubles h, dropping the positions whose
rank is unique. With a threshold of 50 bytes two rounds are enough: names of 25 bytes, then
pairs of names. A row per byte of the corpus would need over thirty times the input in one
shuffle, so the first round ranks one position out of each window of 26: the one whose 25-byte
name hashes least (a minimizer). Equal 50-byte strings hold equal windows, hence the same
minimizer at the same offset, so dropping positions whose minimizer is unique loses nothing. The
second round joins, for the positions left, the name of the 25 bytes with up to 25 bytes on both
sides: exactly the 50-byte strings that hold it. Strings are compared by
two 64-bit hashes: that of the name with half of its context, and that of the whole string.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_shuffles
from .probminhash import distinct_texts, mix64

SPAN = 50
HALF = SPAN // 2
#: Bytes of text whose positions a task holds at a time, bytes of text to a bucket, and bytes hashed at a time.
#: A task of either step needs about 20 times its share; a group sends a packed array to each bucket, so both should
#: grow together (with the executors) as the corpus does: 100 TB want some 256 MB each.
GROUP, BUCKET, SLICE = 8_000_000, 32_000_000, 1 << 18
#: Tied positions with their context that a task holds at a time; texts (2 to this power) whose finds travel together.
TIED, RANGE = 200_000, 9
#: Marks packed rows that need no bucket's work.
DONE = b"D"
G = np.uint64(0xD1342543DE82EF95)
TABLE = mix64(np.arange(1, 257, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15))


def powers(n: int) -> list[np.uint64]:
    out, x = [], 1
    for _ in range(n):
        out.append(np.uint64(x))
        x = x * int(G) % (1 << 64)
    return out


P = powers(HALF + 1)


def names(b: np.ndarray) -> np.ndarray:
    """Names of the HALF bytes from each position (the last HALF - 1 positions have none), by doubling: 1, 2, 4, 8, 16, then 25."""
    with np.errstate(over="ignore"):
        h1 = TABLE[b]
        h, at = h1, 1
        kept = {1: h1}
        while at < 16:
            h = h[:-at] * P[at] + h[at:]
            at *= 2
            kept[at] = h
        n = len(b) - HALF + 1
        out = kept[16][:n] * P[9] + kept[8][16 : 16 + n] * P[1] + h1[24 : 24 + n]
        return mix64(out)


def sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n successive values, by doubling."""
    at = 1
    while at * 2 <= n:
        x = f(x[:-at], x[at:])
        at *= 2
    return f(x[: len(x) - (n - at)], x[n - at :]) if at < n else x


def minimizers(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of a text's minimizers: at least one in each SPAN bytes, chosen by those bytes alone."""
    if len(b) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, "<u8")
    pos, got = [], []
    for lo in range(0, len(b) - SPAN + 1, SLICE):
        # windows lo .. hi - 1 begin here; a position can be chosen by windows of two slices
        hi = min(lo + SLICE, len(b) - SPAN + 1)
        v = names(b[lo : hi + SPAN - 1])
        least = sliding(v, HALF + 1, np.minimum)
        pad = np.zeros(HALF, "<u8")
        most = sliding(np.concatenate([pad, least, pad]), HALF + 1, np.maximum)
        p = np.flatnonzero(most == v)
        pos.append(p + lo)
        got.append(v[p])
    pos, got = np.concatenate(pos), np.concatenate(got)
    pos, first = np.unique(pos, return_index=True)
    return pos, got[first]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, in planes of equal significance, which compress well."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(struct.pack("<4sQ", a.dtype.str.encode().ljust(4), len(a)))
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<4sQ", data, at)
        kind = np.dtype(kind.decode().strip())
        at += 12
        out.append(np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).ravel())
        at += n * kind.itemsize
    return out


def partition_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The partition that repartition(parts, column) gives an int column's values: Spark's Murmur3 of an int with seed 42, modulo parts."""
    with np.errstate(over="ignore"):
        k = x.astype("<u4") * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view("<i4").astype(np.int64) % parts


def bucket_numbers(parts: int) -> np.ndarray:
    """For each partition a number that repartition(parts, column) sends there, so that every task gets one bucket."""
    out, lo, step = np.full(parts, -1, np.int64), 0, 4 * parts + 64
    while (out < 0).any():
        x = np.arange(lo, lo + step)
        at = partition_of(x, parts)
        out[at[::-1]] = np.where(out[at[::-1]] < 0, x[::-1], out[at[::-1]])
        lo += step
    return out


def deal(key: np.ndarray, doc: np.ndarray, uids: np.ndarray, ids: np.ndarray, number: np.ndarray, *cols: np.ndarray):
    """(bucket, packed rows) for rows in order of doc (an index into uids and ids). Keys are mixed first: minimizers are small numbers."""
    buckets = len(number)
    with np.errstate(over="ignore"):
        mixed = mix64(key * G)
    bucket = ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(ends[1:] > ends[:-1]):
        rows = order[ends[k] : ends[k + 1]]
        own, at = np.unique(doc[rows], return_inverse=True)
        yield int(number[k]), pack(key[rows], uids[own], ids[own], np.diff(at, prepend=0).astype("<u4"), *(c[rows] for c in cols))


def collected(blobs: list[bytes]) -> list[np.ndarray]:
    """key, uid, id, other columns of all blobs of a bucket."""
    parts = []
    for key, uids, ids, step, *cols in map(unpack, blobs):
        at = np.cumsum(step)
        parts.append([key, uids[at], ids[at], *cols])
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def by_bucket(batches, work):
    """work(blobs of a bucket) for a partition sorted by bucket; finished rows are marked and go on, one blob at a time."""
    now, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if blob[:1] == DONE:
                yield unpack(blob[1:])
                continue
            if bucket != now:
                if blobs:
                    yield work(blobs)
                now, blobs = bucket, []
            blobs.append(blob)
    if blobs:
        yield work(blobs)


def per_range(uid: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """One row for each range of uids, with the uids and their values of the columns packed."""
    order = np.argsort(uid, kind="stable")
    uid = uid[order]
    place = uid >> RANGE
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(uid) else np.zeros(0, int)
    ends = np.append(starts[1:], len(uid)) if len(uid) else starts
    cols = [uid, *(c[order] for c in cols)]
    return pa.RecordBatch.from_arrays([pa.array(place[starts], pa.int64()), pa.array([pack(*(c[a:b] for c in cols)) for a, b in zip(starts, ends, strict=True)], pa.binary())], names=["range", "found"])


FOUND = "range long, found binary"


def beside(distinct: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """The texts (uid, doc_id, sha, text) dealt by ranges of uid, each range behind what was found in it (uid is null)."""
    place = F.shiftright("uid", RANGE).alias("range")
    texts = distinct.where("doc_id is not null").select(place, "uid", "doc_id", "sha", "text", F.lit(None).cast("binary").alias("found"))
    finds = found.select("range", *[F.lit(None).cast(t).alias(c) for c, t in (("uid", "long"), ("doc_id", "long"), ("sha", "binary"), ("text", "string"))], "found")
    return texts.unionAll(finds).repartition(parts, "range").sortWithinPartitions("range", F.asc_nulls_first("uid"))


def with_finds(batches):
    """(uid, doc_id, sha, bytes, columns found) of each text in which something was found, from the rows of `beside`."""
    place, blobs, cols = None, [], None
    for batch in batches:
        for at, uid, doc_id, sha, text, found in zip(*(batch.column(c).to_pylist() for c in ("range", "uid", "doc_id", "sha", "text", "found")), strict=True):
            if at != place:
                place, blobs, cols = at, [], None
            if uid is None:
                blobs.append(found)
                continue
            if cols is None:
                parts = [np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True)] if blobs else [np.zeros(0, np.int64)]
                order = np.argsort(parts[0], kind="stable")
                cols, blobs = [c[order] for c in parts], []
            lo, hi = np.searchsorted(cols[0], uid), np.searchsorted(cols[0], uid, side="right")
            if lo < hi:
                yield uid, doc_id, sha, text.encode(), [c[lo:hi] for c in cols[1:]]


def grouped(batches):
    """Runs of documents (uid, doc_id, bytes) of about GROUP bytes."""
    some, n = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text")), strict=True):
            some.append((row[0], row[1], row[2].encode()))
            n += len(some[-1][2])
            if n >= GROUP:
                yield some
                some, n = [], 0
    if some:
        yield some


def tied_groups(batches):
    """Runs of (uid, doc_id, bytes, tied positions) of about TIED positions, a longer text in several pieces."""
    some, n = [], 0
    for uid, doc_id, _, raw, (pos,) in with_finds(batches):
        pos = np.unique(pos).astype(np.int64)
        for lo in range(0, len(pos), TIED):
            some.append((uid, doc_id, raw, pos[lo : lo + TIED]))
            n += len(some[-1][3])
            if n >= TIED:
                yield some
                some, n = [], 0
    if some:
        yield some


def rows_of(bucket_blobs) -> pa.RecordBatch:
    bucket, blob = zip(*bucket_blobs, strict=True) if bucket_blobs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "blob"])


def several_docs(key: np.ndarray, ids: np.ndarray, outer: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by key (or by outer and key): group of each row, least id of its group, and if the group has several ids."""
    head = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    if outer is not None and len(key):
        head[1:] |= outer[1:] != outer[:-1]
    group = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    low = np.minimum.reduceat(ids, at) if len(at) else ids
    high = np.maximum.reduceat(ids, at) if len(at) else ids
    return group, low[group], (low != high)[group]


def tied_positions(distinct: DataFrame, buckets: int) -> DataFrame:
    """Round one: (range, found): minimizers of each text whose 25-byte name occurs in another document too, packed by ranges of uid.

    A task sends one row per name and group of texts. Where a group itself holds a name in two
    documents, its rows are tied already and go on without meeting the others, so a line
    that a third of all documents hold is a row per group of texts, not per document.
    """

    number = bucket_numbers(buckets)

    def first(it):
        for some in grouped(it):
            uids, ids = np.array([r[0] for r in some]), np.array([r[1] for r in some])
            found = [minimizers(np.frombuffer(r[2], np.uint8)) for r in some]
            doc = np.repeat(np.arange(len(some)), [len(p) for p, _ in found])
            pos, key = np.concatenate([p for p, _ in found]).astype("<u4"), np.concatenate([k for _, k in found])
            order = np.argsort(key, kind="stable")
            _, _, many = several_docs(key[order], ids[doc[order]])
            head = np.append(True, key[order][1:] != key[order][:-1]) if len(key) else many
            tied = np.zeros(len(key), bool)
            tied[order] = many
            send = ~tied
            send[order] |= head & many  # one row tells the others
            rows = np.flatnonzero(send)
            yield rows_of(list(deal(key[rows], doc[rows], uids, ids, number, pos[rows], tied[rows].astype("u1"))))
            at = np.flatnonzero(tied)
            if len(at):
                yield rows_of([(int(number[uids[0] % buckets]), DONE + pack(uids[doc[at]], pos[at]))])

    def second(it):
        def work(blobs):
            key, uid, ids, pos, known = collected(blobs)
            order = np.argsort(key, kind="stable")
            group, _, many = several_docs(key[order], ids[order])
            if len(key):
                many = many | (np.maximum.reduceat(known[order], np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])))[group] > 0)
            out = order[many & (known[order] == 0)]
            return [uid[out], pos[out]]

        for uid, pos in by_bucket(it, work):
            yield per_range(uid, pos)

    dealt = distinct.where("doc_id is not null").select("uid", "doc_id", "text").mapInArrow(first, "bucket int, blob binary")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(second, FOUND)


def sides(b: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The HALF bytes before (nearest first) and after the names at pos, zero beyond the text's ends, and how many there are."""
    runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(HALF, np.uint8), b, np.zeros(SPAN, np.uint8)]), HALF)
    return runs[pos][:, ::-1], runs[pos + 2 * HALF], np.minimum(pos, HALF), np.minimum(len(b) - pos - HALF, HALF)


def folded(start: np.ndarray, side: np.ndarray) -> np.ndarray:
    """start folded with a number of bytes, column by column."""
    for j in range(side.shape[1]):
        start = start * G + TABLE[side[:, j]]
    return start


def repeated_spans(distinct: DataFrame, tied: DataFrame, buckets: int) -> DataFrame:
    """Round two: (range, found): byte ranges, starts and ends, covered by a SPAN-byte string that also starts in a smaller doc_id.

    A string that holds a name at offset o has o bytes of the left side and HALF - o of the right.
    Those with o < 13 hold 13 bytes of the right side, the others 13 of the left; keys take them in, so a
    name that is frequent everywhere is dealt out by what stands beside it. Rows of a
    group of texts that agree in all bytes are answered there if their document is not the least.
    """
    near, number = HALF // 2 + 1, bucket_numbers(buckets)

    def first(it):
        for some in tied_groups(it):
            uids, ids = np.array([r[0] for r in some]), np.array([r[1] for r in some])
            parts = []
            for k, (_, _, raw, pos) in enumerate(some):
                b = np.frombuffer(raw, np.uint8)
                name = folded(np.full(len(pos), G), np.lib.stride_tricks.sliding_window_view(b, HALF)[pos])
                parts.append((np.full(len(pos), k), pos, name, *sides(b, pos)))
            doc, pos, name, left, right, nl, nr = (np.concatenate(c) for c in zip(*parts, strict=True))
            spans = []
            for which, (one, other, n_one, n_other) in enumerate(((right, left, nr, nl), (left, right, nl, nr))):
                with np.errstate(over="ignore"):
                    # `one` gives near bytes or more, `other` at most HALF - near
                    key = mix64(folded(name + np.uint64(which), one[:, :near]))
                    rest = np.concatenate([one[:, near:], other[:, : HALF - near]], axis=1)
                    whole = mix64(folded(key * G + n_one.astype("<u8") * np.uint64(64) + n_other.astype("<u8"), rest))
                use = np.flatnonzero((n_one >= near) & (n_one + n_other >= HALF))
                if not len(use):
                    continue
                order = use[np.lexsort((pos[use], ids[doc[use]], key[use], whole[use]))]
                _, low, _ = several_docs(key[order], ids[doc[order]], whole[order])
                done = order[ids[doc[order]] > low]
                # all strings that hold at least `near` bytes of `one`
                a, b_ = np.minimum(n_one[done], HALF), np.minimum(n_other[done], HALF - near)
                lo, hi = (pos[done] - b_, pos[done] + HALF + a) if which == 0 else (pos[done] - a, pos[done] + HALF + b_)
                spans.append((doc[done], lo, hi))
                rows = np.sort(order[ids[doc[order]] == low])
                yield rows_of(list(deal(key[rows], doc[rows], uids, ids, number, pos[rows].astype("<u4"), np.full(len(rows), which, "u1"), n_one[rows].astype("u1"), n_other[rows].astype("u1"), *rest[rows].T)))
            if spans:
                doc, lo, hi = (np.concatenate(c) for c in zip(*spans, strict=True))
                if len(doc):
                    yield rows_of([(int(number[uids[0] % buckets]), DONE + pack(uids[doc], lo.astype("<u4"), hi.astype("<u4")))])

    def second(it):
        def work(blobs):
            key, uid, ids, pos, which, n_one, n_other, *rest = collected(blobs)
            rest = np.stack(rest, axis=1)
            order = np.argsort(key, kind="stable")
            _, _, many = several_docs(key[order], ids[order])
            rows = order[many]  # a key of one document has nothing to meet
            key, uid, ids, pos, which, n_one, n_other, rest = key[rows], uid[rows], ids[rows], pos[rows].astype(np.int64), which[rows], n_one[rows].astype(int), n_other[rows].astype(int), rest[rows]
            most, least = np.full(len(rows), -1), np.full(len(rows), SPAN)  # covered counts of bytes of `other`
            with np.errstate(over="ignore"):
                whose = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(key) else key  # rows are in order of key
                ones = [key]
                for j in range(HALF - near):
                    ones.append(ones[-1] * G + TABLE[rest[:, j]])
                tail = np.full(len(rows), G)
                for o in range(HALF - near + 1):  # o bytes of `other`, HALF - o of `one`
                    if o:
                        tail = tail * G + TABLE[rest[:, HALF - near + o - 1]]
                    ok = np.flatnonzero((n_other >= o) & (n_one >= HALF - o))
                    if not len(ok):
                        continue
                    string = mix64(ones[HALF - near - o][ok] + mix64(tail[ok] + np.uint64(o)))
                    by = np.lexsort((string, whose[ok]))
                    _, low, _ = several_docs(string[by], ids[ok[by]], whose[ok[by]])
                    hit = ok[by][ids[ok[by]] > low]
                    most[hit] = np.maximum(most[hit], o)
                    least[hit] = np.minimum(least[hit], o)
            got = np.flatnonzero(most >= 0)
            pos, which, most, least = pos[got], which[got], most[got], least[got]
            lo = np.where(which == 0, pos - most, pos - (HALF - least))
            hi = np.where(which == 0, pos + HALF + (HALF - least), pos + HALF + most)
            return [uid[got], lo.astype("<u4"), hi.astype("<u4")]

        for uid, lo, hi in by_bucket(it, work):
            yield per_range(uid, lo, hi)

    dealt = beside(distinct, tied, buckets).mapInArrow(first, "bucket int, blob binary")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(second, FOUND)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal runs (touching ranges are one run)."""
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.append(True, lo[1:] > hi[:-1])
    return lo[head], hi[np.append(np.flatnonzero(head)[1:] - 1, len(hi) - 1)]


def changes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, distinct, changed): the two tables of distinct_texts, and the distinct texts that lose bytes."""
    spark = docs.sparkSession
    ids, distinct = distinct_texts(docs, id_col, text_col)
    total = ids.where("doc_id is not null").agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // BUCKET) + 1)
    free_shuffles(spark)
    tied = cut(tied_positions(distinct, buckets), "tied")
    free_shuffles(spark)
    spans = cut(repeated_spans(distinct, tied, buckets), "spans")
    free_shuffles(spark)

    def last(it):
        out, held = [], 0
        for _, i, sha, raw, found in with_finds(it):
            lo, hi = merged(*found)
            ends = np.append(0, hi), np.append(lo, len(raw))
            kept = b"".join(raw[a:b] for a, b in zip(*ends, strict=True))
            out.append((i, sha, int((hi - lo).sum()), len(lo), kept, hashlib.sha256(kept).hexdigest()))
            held += len(kept)
            if held >= GROUP:
                yield changed_rows(out)
                out, held = [], 0
        if out:
            yield changed_rows(out)

    def changed_rows(out):
        cols = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["id", "sha", "gone", "runs", "kept", "kept_sha"])

    changed = beside(distinct, spans, buckets).mapInArrow(last, "id long, sha binary, gone long, runs long, kept binary, kept_sha string")
    return ids, distinct, changed


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256. Only hashes move in its last joins.

    A byte goes if a SPAN-byte string that covers it also starts in a document with a smaller
    doc_id; strings are judged on the input and never cross documents. Equal texts are handled
    once: all but the least id lose all bytes (if there are SPAN or more). A null text is empty.
    Rows with a null id neither lose bytes nor take any from others, and rows with the same id
    take none from each other. Repeated rows each give a row; an empty table gives none.
    """
    ids, _, changed = changes(docs, id_col, text_col)
    return _rows(ids, changed.drop("kept")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _rows(ids: DataFrame, changed: DataFrame) -> DataFrame:
    lead = cut(ids.groupBy("sha").agg(F.min("doc_id").alias("least")), "leads")  # a table of its own, so that adaptive execution can split a hot text's rows
    copy = F.col("doc_id").isNotNull() & (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= SPAN)
    same = cut(ids.join(lead, "sha"), "ids").join(changed.withColumnRenamed("id", "doc_id"), ["sha", "doc_id"], "left")
    return same.select(
        "doc_id", "sha", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
        copy.alias("whole"), *([F.col("kept")] if "kept" in changed.columns else []),
    )


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of dedup with kept, the bytes that stay (a cut may split a character)."""
    ids, distinct, changed = changes(docs, id_col, text_col)
    texts = distinct.select("sha", F.col("text").cast("binary").alias("raw"))
    out = _rows(ids, changed).join(texts, "sha")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.when(F.col("whole"), F.lit(b"")).otherwise(F.coalesce("kept", "raw")).alias("kept"))
