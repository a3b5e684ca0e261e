"""Near-duplicates by ProbMinHash (Ertl 2020): element arrivals of Poisson processes, banding, exact verification, components."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, free_shuffles
from .pieces import ragged

WORD = re.compile(r"\w+")
SHINGLE = 5
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Rows and bytes of text of a bucket on one side of a block of comparisons.
BLOCK, BLOCK_BYTES = 1024, 16_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); overflow is meant."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordCodes(dict):
    """word -> 64-bit code; a bounded cache."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: str) -> int:
        got = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        if len(w) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[w] = got
        return got


def shingles(text: str, codes: WordCodes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of a whole text, as sorted 64-bit codes, and how often each occurs. Fewer words than `size` are one shingle; no word, none."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, "<u8"), np.zeros(0, "<i8")
    h = np.fromiter(map(codes.__getitem__, words), "<u8", len(words))
    k = min(size, len(h))
    s = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        s = mix64(s * GOLD + h[j : len(h) - k + 1 + j])
    return np.unique(s, return_counts=True)


def registers(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """A row of m registers for each weighted set: in each, the element that arrives first.

    Element d of weight w has a Poisson process of rate w, driven by random numbers that depend on
    d alone; every arrival falls into a random register. An element stops (early termination)
    once its next arrival is later than all registers of its set. Two sets agree in a register
    with the probability of their probability Jaccard coefficient. Sets must not be empty.
    """
    sizes = [len(e) for e, _ in sets]
    doc = np.repeat(np.arange(len(sets)), sizes)
    el = np.concatenate([e for e, _ in sets])
    rate = np.concatenate([c / c.sum() for _, c in sets])
    first = np.full(len(sets) * m, np.inf)
    who = np.zeros(len(sets) * m, "<u8")
    x = np.zeros(len(el))
    act, k = np.arange(len(el)), np.uint64(0)
    with np.errstate(over="ignore"):
        while len(act):
            k += np.uint64(1)
            r = mix64(el[act] + k * GOLD)
            x[act] -= np.log1p(-((r >> np.uint64(11)) * 2.0**-53)) / rate[act]
            slot = doc[act] * m + ((mix64(r ^ GOLD) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            better = np.flatnonzero(x[act] < first[slot])
            late_first = better[np.argsort(-x[act[better]], kind="stable")]
            first[slot[late_first]] = x[act[late_first]]
            who[slot[late_first]] = el[act[late_first]]
            last = first.reshape(len(sets), m).max(axis=1)
            act = act[x[act] < last[doc[act]]]
    return who.reshape(len(sets), m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exactly: the sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d). For sets (all counts 1) it is the Jaccard coefficient."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    p, q = np.zeros(len(every)), np.zeros(len(every))
    p[at[: len(a[0])]] = a[1] / a[1].sum()
    q[at[len(a[0]) :]] = b[1] / b[1].sum()
    with np.errstate(divide="ignore"):
        order = np.argsort(np.where(q > 0, p / np.where(q > 0, q, 1), np.inf), kind="stable")
    p, q = p[order], q[order]
    low_q = np.cumsum(q)  # up to d the ratio b_e / b_d is the greater, beyond it a_e / a_d
    high_p = p.sum() - np.cumsum(p)
    both = (p > 0) & (q > 0)
    return float((1 / (low_q[both] / q[both] + high_p[both] / p[both])).sum())


def band_codes(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(bands, dtype="<u8"), (len(regs), 1))
        for r in range(rows):
            out = mix64(out * GOLD + regs[:, r::rows][:, :bands])
    return out


def sketches(distinct: DataFrame, bands: int, rows: int) -> DataFrame:
    """(uid, codes array<long>) of each text that has a word: one code for each band of registers."""

    def run(it):
        codes = WordCodes()
        for batch in it:
            uid, sets, n = [], [], 0
            for u, t in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingles(t, codes)
                if len(s[0]):
                    uid.append(u)
                    sets.append(s)
                    n += len(s[0])
                if n > 200_000:
                    yield done(uid, sets)
                    uid, sets, n = [], [], 0
            if sets:
                yield done(uid, sets)

    def done(uid, sets):
        regs = registers(sets, bands * rows)
        code = band_codes(regs, bands, rows).view("<i8")
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(code.tolist(), pa.list_(pa.int64()))], names=["uid", "codes"])

    return distinct.select("uid", "text").mapInArrow(run, "uid long, codes array<long>")


def verified(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b), those whose probability Jaccard is at least `least`: (a, b, similarity). Only texts in a pair move."""
    one = distinct.select(F.col("uid").alias("a"), F.col("text").alias("ta"))
    two = distinct.select(F.col("uid").alias("b"), F.col("text").alias("tb"))

    def run(it):
        codes = WordCodes()
        for batch in it:
            out, key, kept = [], None, None
            for a, b, ta, tb in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ta", "tb")), strict=True):
                if key != b:
                    key, kept = b, shingles(tb, codes)
                if (s := probability_jaccard(shingles(ta, codes), kept)) >= least - 1e-9:
                    out.append((a, b, s))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def shingle_sets(distinct: DataFrame) -> DataFrame:
    """(uid, elements binary, counts binary): the weighted shingles of each text that has a word."""

    def run(it):
        codes = WordCodes()
        for batch in it:
            out, held = [], 0
            for u, t in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                e, c = shingles(t, codes)
                if len(e):
                    out.append((u, e.tobytes(), c.astype("<u4").tobytes()))
                    held += 12 * len(e)
                if held >= BLOCK_BYTES:
                    yield rows(out)
                    out, held = [], 0
            yield rows(out)

    def rows(out):
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["uid", "elements", "counts"])

    return distinct.select("uid", "text").mapInArrow(run, "uid long, elements binary, counts binary")


def block_links(i: int, j: int, band: int, own: np.ndarray, uid: np.ndarray, comp: np.ndarray, lead: np.ndarray, codes: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], least: float):
    """Verified links (a, b, similarity) between two blocks i, j of a bucket, at most one for each merge of components.

    Compared are pairs of different components (as merged so far, here) of which neither is the
    bucket's leader and which share no earlier band. Of two distributions the sum s of the lesser probabilities bounds
    the probability Jaccard from above (no coupling meets more often); pairs with s >= least are computed exactly.
    """
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    sizes = np.array([len(e) for e, _ in sets])
    starts = np.cumsum(sizes) - sizes
    _, word = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True)
    share = np.concatenate([c / c.sum() for _, c in sets])
    dense = np.zeros(int(word.max()) + 1)
    now = comp.copy()  # components as merged here
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    right = right[uid[right] != lead[right]]
    for x in left[uid[left] != lead[left]]:
        ys = right[now[right] != now[x]]
        if i == j:
            ys = ys[uid[ys] > uid[x]]
        if len(ys):
            ys = ys[~(codes[ys, :band] == codes[x, :band]).any(axis=1)]
        if not len(ys):
            continue
        own_x = slice(starts[x], starts[x] + sizes[x])
        dense[word[own_x]] = share[own_x]
        at = ragged(starts[ys], sizes[ys])
        most = np.add.reduceat(np.minimum(dense[word[at]], share[at]), np.cumsum(sizes[ys]) - sizes[ys])
        dense[word[own_x]] = 0
        for y in ys[most >= least - 1e-9]:
            cx, cy = find(int(comp[x])), find(int(comp[y]))
            if cx != cy and (s := probability_jaccard(sets[x], sets[y])) >= least - 1e-9:
                root[max(cx, cy)] = min(cx, cy)
                now[now == max(cx, cy)] = min(cx, cy)
                yield int(max(uid[x], uid[y])), int(min(uid[x], uid[y])), s


def rest_of_buckets(members: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b, similarity) that members (band, code, uid, comp, lead, blocks, codes, elements, counts) of open buckets still need.

    Rows of a bucket are dealt to `blocks` blocks; every pair of blocks of a bucket is a
    group of its own, so a bucket with any number of rows is spread over tasks, each of which holds two blocks. A group
    gives no more links than it merges components.
    """
    dealt = members.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ("band", "code", "i", "j", "own", "uid", "comp", "lead", "codes", "elements", "counts")
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(*names)
    dealt = dealt.repartition("band", "code", "i", "j").sortWithinPartitions("band", "code", "i", "j")

    def compare(group):
        band, _, i, j, own, uid, comp, lead, codes, elements, counts = zip(*group, strict=True)
        sets = [(np.frombuffer(e, "<u8"), np.frombuffer(c, "<u4").astype(np.int64)) for e, c in zip(elements, counts, strict=True)]
        return block_links(i[0], j[0], band[0], np.array(own), np.array(uid), np.array(comp), np.array(lead), np.array(codes), sets, least)

    def run(it):
        key, group = None, []
        for batch in it:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if key != row[:4]:
                    if len(group) > 1:
                        out += compare(group)
                    key, group = row[:4], []
                group.append(row)
            yield links(out)
        if len(group) > 1:
            yield links(list(compare(group)))

    def links(out):
        a, b, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return dealt.mapInArrow(run, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ids, distinct): ids (doc_id, sha) of every row; distinct (uid, doc_id, sha, text), one row per text, with its least id.

    Both are tables in the shared folder, so uid is fixed. The groups are formed on the 32-byte
    hashes with map-side minima: a third of the rows being one text is one row per task; the text
    itself moves once, to its hash's least id.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    ids = cut(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "ids")
    lead = ids.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    d = F.coalesce("doc_id", F.lit(-(1 << 63)))
    one = rows.withColumn("d", d).join(lead.select("sha", d.alias("d")), ["sha", "d"])  # copies have other ids: no hot key
    if ids.groupBy("sha", "doc_id").count().where("count > 1").limit(1).count():
        one = one.dropDuplicates(["sha"])  # rows that repeat id and text
    return ids, cut(one.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "sha", "text"), "texts", "lz4")


def classes(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (least doc_id of its class), class_size, joining_links (those of its text's verified links that joined the class: with a bucket's least member, or between components; not all that it has).

    Classes are the components of links between texts whose probability Jaccard over 5-word
    shingles is at least `least`, and of equal texts (one node each). Candidates share a band
    of registers (a pair at 0.8 is missed with probability 5e-5). Of each bucket, all members are first
    verified against its least; buckets that still hold several components are then compared in
    blocks, exactly and without a cap, so a link that misses the least member is found too. Texts without a
    word are alike only if equal; null and empty texts are one text. A class of null ids only has
    class_id null. An empty table gives no rows.
    """
    ids, distinct = distinct_texts(docs, id_col, text_col)
    links, nodes = near_links(distinct, least, bands, rows)
    degree = links.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("joining_links"))
    comp = distinct.select("uid", "doc_id", "sha").join(nodes, "uid", "left").join(degree, "uid", "left")
    comp = comp.select("sha", "doc_id", F.coalesce("comp", "uid").alias("comp"), F.coalesce("joining_links", F.lit(0)).cast("long").alias("joining_links"))
    least_id = comp.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    label = comp.join(least_id, "comp").select("sha", "comp", "class_id", "joining_links")
    rows_ = cut(ids.join(label, "sha").select("doc_id", "comp", "class_id", "joining_links"), "labels")
    sizes = rows_.groupBy("comp").agg(F.count("*").alias("class_size"))
    return rows_.join(sizes, "comp").select("doc_id", "class_id", "class_size", "joining_links")


def near_links(distinct: DataFrame, least: float, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(links, nodes): links (a, b, similarity) between uids of distinct (uid, text), enough of all verified ones to give all classes; nodes (uid, comp), their components."""
    spark = distinct.sparkSession
    drawn = cut(sketches(distinct, bands, rows), "sketches")
    places = drawn.select("uid", F.posexplode("codes").alias("band", "code"))
    buckets = cut(places.groupBy("band", "code").agg(F.min("uid").alias("lead"), F.count("*").alias("n")).where("n > 1"), "buckets")
    inside = places.join(buckets, ["band", "code"])
    star = cut(inside.where("uid <> lead").select(F.col("uid").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    links = cut(verified(star, distinct, least), "links")
    free_shuffles(spark)
    found = cut(components(links).withColumnRenamed("node", "uid"), "nodes")
    # buckets of three or more in which not all are one component: pairs without the leader are still open
    placed = cut(inside.where("n > 2").join(found, "uid", "left").select("band", "code", "uid", "lead", "n", F.coalesce("comp", "uid").alias("comp")), "members")
    open_ = placed.groupBy("band", "code").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "code")
    members = cut(placed.join(open_, ["band", "code"], "left_semi"), "members")
    # every text of an open bucket once, with its shingles; blocks by rows and by bytes
    sets = cut(shingle_sets(distinct.join(members.select("uid").distinct(), "uid", "left_semi")).join(drawn, "uid"), "sets")
    sized = members.join(sets.select("uid", F.length("elements").alias("bytes")), "uid").groupBy("band", "code").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    blocks = sized.select("band", "code", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    later = cut(rest_of_buckets(members.join(blocks, ["band", "code"]).join(sets, "uid"), least), "links")
    free_shuffles(spark)
    if not later.limit(1).count():
        return links, found
    # the later links join components of the first
    names = found.select(F.col("uid").alias("x"), "comp")
    joined = later.join(names, later["a"] == names["x"], "left").select(F.coalesce("comp", "a").alias("a"), "b").join(names, F.col("b") == F.col("x"), "left").select("a", F.coalesce("comp", "b").alias("b"))
    merged = cut(components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("whole")), "merged")
    ends = found.select("uid", "comp").unionAll(later.select(F.explode(F.array("a", "b")).alias("uid")).distinct().join(found, "uid", "left_anti").select("uid", F.col("uid").alias("comp")))
    nodes = cut(ends.join(merged, "comp", "left").select("uid", F.coalesce("whole", "comp").alias("comp")), "nodes")
    return links.unionAll(later), nodes


def keep_one(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id is not the least of their class, and with one of rows that repeat id and text. Rows with a null id stay."""
    gone = classes(docs, least, id_col=id_col, text_col=text_col).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    if docs.where(docs[id_col].isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count():
        docs = docs.where(docs[id_col].isNull()).unionByName(docs.where(docs[id_col].isNotNull()).dropDuplicates([id_col, text_col]))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
