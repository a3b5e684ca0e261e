"""SpotSigs (Theobald, Siddharth and Paepcke 2008): chains of content words that follow common-word anchors."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_ranges, texts

WORD = re.compile(r"\w+")
#: Anchors (fixed values): common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be been but by can do for from had has have he if in is it its not of on or she so that the their there they this to was we were which will with you "
    "als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch oder sich sie sind über um und uns vom von vor war wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella en entre era es esta este fue ha hay las lo los más no o para pero por se si sin sobre su sus también un una y ya".split()
)
CHAIN = 2
#: Bits of a signature: two chains of a pair of texts with some thousand each coincide once in 10^8 pairs.
BITS = 48


def word_code(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class Codes(dict):
    """word -> 64-bit code whose lowest bit says if the word is an anchor; a bounded cache."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: str) -> int:
        got = word_code(w) & ~1 | (w in ANCHORS)
        if len(w) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[w] = got
        return got


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(text: str, codes: Codes, chain: int = CHAIN) -> np.ndarray:
    """The sorted distinct signatures of a whole text, of BITS bits.

    The start of a text is an anchor too, so every text with a word has one; a chain cut off by
    the text's end is shorter. A text that has characters but no word has the one signature of
    its characters; an empty text has none.
    """
    words = WORD.findall(text.lower())
    if not words:
        return np.array([word_code("\0" + text) >> (64 - BITS)], "<u8") if text else np.zeros(0, "<u8")
    code = np.fromiter(map(codes.__getitem__, words), "<u8", len(words))
    anchor = (code & np.uint64(1)).astype(bool)
    content = np.append(code[~anchor], np.zeros(chain, "<u8"))
    seen = np.cumsum(~anchor)
    at = np.append(np.uint64(0), seen[anchor]).astype(np.int64)
    sig = np.append(np.uint64(3), code[anchor])
    with np.errstate(over="ignore"):
        for k in range(chain):
            sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + content[at + k])
    full = content[at] != 0
    full[0] = True
    return np.unique(sig[full] >> np.uint64(64 - BITS))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted distinct arrays; two empty sets are alike (1), an empty and another are not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def printed(sig: np.ndarray) -> str:
    """A whole set as text: how many signatures, then all of them in order, BITS / 4 hex digits each. '' for the empty set."""
    return f"{len(sig)}:" + sig.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes().hex() if len(sig) else ""


def read(fingerprint: str) -> np.ndarray:
    """The set that `printed` wrote."""
    digits = fingerprint.partition(":")[2]
    return np.array([int(digits[k : k + BITS // 4], 16) for k in range(0, len(digits), BITS // 4)], "<u8")


def range_of(splits: list[int]) -> Column:
    """The number of split points at or below the column `key`: a binary search in the sorted splits, from the highest bit of the answer down."""
    if not splits:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>")  # one constant, however many
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splits).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("key"), at + step).otherwise(at))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edit and of the next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    Documents stand in descending doc_id (equal ids by text, null ids last); the edit replaces a
    text's last floor(n / 2) code points by the first as many of the next document's; after the
    last comes the first. Likeness is the Jaccard coefficient of the whole signature sets.
    Rows are dealt once, by ranges of doc_id found from that column; each range also gets the
    first row of the next lower one. A null text is empty. One row alone is its own next. An
    empty table gives no row.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    keyed = rows.select(key.alias("key"), "doc_id", "text")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = id_ranges(keyed.select("key"), "key", 4 * parts)  # several ranges to a partition even out
    where = range_of(splits)
    tops = keyed.select(where.alias("range"), "key").groupBy("range").agg(F.max("key").alias("top")).orderBy("range").collect()  # one row for each range
    halo = {tops[k]["top"]: tops[(k + 1) % len(tops)]["range"] for k in range(len(tops))}  # the top row of a range is next for the range above; that of the highest, for the lowest
    dealt = keyed.select(where.alias("range"), F.lit(0).alias("role"), "key", "doc_id", "text")
    if halo:
        to = spark.createDataFrame(list(halo.items()), "key long, range int")  # one row for each range
        dealt = dealt.unionAll(keyed.join(F.broadcast(to), "key").select("range", F.lit(1).alias("role"), "key", "doc_id", "text"))
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "role", F.desc("key"), F.desc("text"))

    def run(it):
        codes = Codes()
        last, done = None, False  # the row whose next is not yet known; whether its range's halo was read

        def pair(a, b):
            (_, i, t, sig), (_, _, u, other) = a, b
            half = len(t) // 2
            edited = t[: len(t) - half] + u[:half]
            esig = signatures(edited, codes)
            return i, len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(sig), printed(esig), jaccard(sig, esig), jaccard(sig, other), len(sig)

        for batch in it:
            out = []
            for g, role, i, t in zip(*(batch.column(n).to_pylist() for n in ("range", "role", "doc_id", "text")), strict=True):
                if last is not None and last[0] != g:
                    last, done = None, False
                if role and done:
                    continue
                row = (g, i, t, signatures(t, codes))
                if last is not None:
                    out.append(pair(last, row))
                last, done = row, bool(role)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*out, strict=True)) or [[]] * 8, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long")


def signature_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sigs array<long>, n): the whole signature set of every text."""

    def run(it):
        codes = Codes()
        for batch in it:
            sigs = [signatures(t, codes).view("<i8") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tolist() for s in sigs], pa.list_(pa.int64())), pa.array([len(s) for s in sigs], pa.int32())], names=["doc_id", "sigs", "n"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, sigs array<long>, n int")


def similar_pairs(docs: DataFrame, tau: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of classes of equal signature sets with Jaccard >= tau; a, b are the classes' least doc_id.

    Equal sets are one class first, so copies make no pairs. Sets are partitioned by length:
    part p holds lengths in [tau^-p, tau^-(p+1)), and a set can only match its own part and the
    neighbours: the join's key is part and signature, and a set meets the shorter ones of its part and the part before.
    Within it the rarest signatures (floor((1 - tau) * n) + 1 of them, by frequency
    in all sets) meet in a join, and the exact coefficient prunes. Empty sets match nothing.
    """
    sets = signature_sets(docs, id_col, text_col).where("n > 0 and doc_id is not null")
    classes = cut(sets.groupBy("sigs", "n").agg(F.min("doc_id").alias("id")), "spots")
    freq = classes.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("f"))
    ranked = classes.select("id", "n", F.explode("sigs").alias("s")).join(freq, "s")
    prefix = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("r")).select("id", "n", F.explode(F.expr(f"transform(slice(r, 1, cast(floor((1 - {tau}) * n + 1e-9) as int) + 1), x -> x.s)")).alias("s"))
    parted = prefix.withColumn("part", F.expr(f"cast(floor(ln(n) / -ln({tau}) + 1e-9) as int)")) if 0 < tau < 1 else prefix.withColumn("part", F.when(F.lit(tau == 1), F.col("n")).otherwise(0))
    a, b = parted.alias("a"), parted.withColumn("part", F.explode(F.array("part", F.col("part") - 1))).alias("b")
    near = a.join(b, F.expr(f"a.part = b.part and a.s = b.s and (a.n < b.n or (a.n = b.n and a.id < b.id)) and a.n >= {tau} * b.n - 1e-9")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    x, y = classes.select(F.col("id").alias("x"), F.col("sigs").alias("sx")), classes.select(F.col("id").alias("y"), F.col("sigs").alias("sy"))
    both = near.join(x, "x").join(y, "y").withColumn("i", F.size(F.array_intersect("sx", "sy")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("i") / (F.size("sx") + F.size("sy") - F.col("i"))).alias("likeness")).where(F.col("likeness") >= tau)
