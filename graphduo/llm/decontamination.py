"""Benchmark passages in documents: cosine search in a latent space of TF-IDF passages, then longest common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .pieces import runs

SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Leading directions of the passages that the latent space takes in, extra random columns, power iterations.
RANK, EXTRA, POWER = 64, 8, 2
#: Words of a passage of the matrix.
PASSAGE = 64
#: Items that share a latent space; characters of benchmark text in a block of queries (some 1000 items, under 50,000 terms).
SPACE_ITEMS, BLOCK_CHARS = 256, 250_000
#: A term in more than this share of the documents has no weight in the latent space (it has in the subsequences).
COMMON = 0.1
#: Least cosine of a candidate.
LEAST_COS = 0.3
#: Words, and windows of one document, that are searched at a time.
CHUNK_WORDS, CHUNK_BLOCKS = 8192, 512


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of texts, runs of letters, digits and underscores in lower case; a text without any has one empty word."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}_]+", " ")
    return pc.split_pattern(pc.utf8_trim(plain, " "), " ")


def words(text: str) -> list[str]:
    return [w for w in words_of(pa.array([text], pa.string()))[0].as_py() if w]


class Space:
    """Up to SPACE_ITEMS items as vectors: their span and the leading directions of all passages, so that no item loses weight by projection.

    For an item q and a passage p, q . P(p) = q . p, and P(p) is no longer than p: the cosine in the space is at
    least that of the TF-IDF vectors. What the items and the leading directions cannot express of a passage does not count.
    """

    def __init__(self, own: np.ndarray, words: list[np.ndarray], weight: np.ndarray, leading: np.ndarray, mass: np.ndarray, share: float):
        """mass: the items' full weight, of which a window must have `share` in common with them."""
        self.own = own
        self.terms = np.unique(np.concatenate(words))
        w = weight[self.terms]
        rows = np.zeros((len(words), len(self.terms)), np.float64)
        for k, x in enumerate(words):
            np.add.at(rows[k], np.searchsorted(self.terms, x), 1.0)
        rows *= w
        length = np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
        rows /= length
        u, size, _ = np.linalg.svd(np.concatenate([rows, 1e-3 * leading[self.terms].T]).T, full_matrices=False)
        basis = u[:, size > 1e-9]
        self.latent = (w[:, None] * basis).astype(np.float32)
        self.query = (rows @ basis).astype(np.float32)
        #: the least q . p of a window with so much in common: it has that weight at least in squares, from the lightest words up
        self.low = np.zeros(len(words), np.float32)
        for k, x in enumerate(words):
            own_w = np.sort(weight[x])
            held = np.cumsum(own_w)
            need = share * mass[k] - (mass[k] - held[-1])  # common terms, which have no weight here, may be all there
            j = min(int(np.searchsorted(held, need)), len(x) - 1)
            if need > 0:
                self.low[k] = 0.999 * ((own_w[:j] ** 2).sum() + (need - (held[j - 1] if j else 0)) * own_w[j]) / length[k, 0]
        sizes = np.array([len(x) for x in words])
        #: (words of a step, steps of a window, items): every run of as many words as an item of the class has lies in a window.
        self.classes = []
        top = 8
        while (sizes > (top // 2 if top > 8 else 0)).any():
            if len(at := np.flatnonzero((sizes <= top) & (sizes > (top // 2 if top > 8 else 0)))):
                step = 8 if top == 8 else max(16, top // 2)
                self.classes.append((step, top // step + 1, at))
            top *= 2
        self.base = min(step for step, _, _ in self.classes)
        self.most = max(step for step, _, _ in self.classes) // self.base
        #: blocks of silence behind a text, so that no window reaches into the next
        self.gap = max((n - 1) * step for step, n, _ in self.classes) // self.base


class Items:
    """A block of benchmark items: their words as term numbers, the terms' weights, and their latent spaces."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.answers, self.term = [], [], [], {}
        for i, text in rows:
            own = [self.term.setdefault(w, len(self.term)) for w in words(text)]
            if not own:
                continue
            n = min(max(len(words(SENTENCE.split(text.strip())[-1])), 3), len(own))
            self.ids.append(i)
            self.words.append(np.array(own, np.int32))
            self.answers.append(n)
        self.idf = np.zeros(len(self.term), np.float32)
        self.weight, self.spaces = self.idf, []

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """Smoothed inverse document frequency; df and n_docs count the whole table. weight: the same, 0 for common terms.

        An item that would lose two thirds of its weight keeps all its terms.
        """
        self.idf = (np.log((1 + n_docs) / (1 + df)) + 0.1).astype(np.float32)
        self.mass = np.array([self.idf[w].sum() for w in self.words], np.float32)
        keep = df <= COMMON * n_docs
        for w, mass in zip(self.words, self.mass, strict=True):
            if self.idf[w][keep[w]].sum() < mass / 3:
                keep[w] = True
        self.weight = np.where(keep, self.idf, 0).astype(np.float32)

    def place(self, leading: np.ndarray, share: float) -> None:
        """The latent spaces of successive items of like length, given the leading directions of all passages and the share of its weight that a held item has at least."""
        order = np.argsort([len(w) for w in self.words], kind="stable")
        self.spaces = [Space(order[k : k + SPACE_ITEMS], [self.words[i] for i in order[k : k + SPACE_ITEMS]], self.weight, leading, self.mass[order[k : k + SPACE_ITEMS]], share) for k in range(0, len(order), SPACE_ITEMS)]


def blocks_of(bench: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in blocks of bounded size: the queries, each block held against all documents."""
    rows, n = [], 0
    for i, t in bench.select(bench[id_col].cast("long"), bench[text_col]).where(bench[text_col].isNotNull()).orderBy(id_col).toLocalIterator():
        rows.append((i, t))
        n += len(t)
        if n >= BLOCK_CHARS:
            yield Items(rows)
            rows, n = [], 0
    if rows:
        yield Items(rows)


def hits_of(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, pos binary, term binary): where the words of the whole text are words of the items. All that follows needs no more of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(list(items.term))  # words of BLOCK_CHARS characters, or of one item if that is longer

    def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        """int32 values as binary rows that end at `ends`."""
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 4 * ends).astype("<i4").tobytes()), pa.py_buffer(values.astype("<i4").tobytes())])

    def run(it):
        terms = pa.array(shared.value, pa.string())
        for batch in it:
            text, ids = batch.column("text"), batch.column("doc_id")
            for lo, hi in runs(pc.binary_length(text).to_numpy(zero_copy_only=False)):
                split = words_of(text.slice(lo, hi - lo))
                coded = split.flatten().dictionary_encode()
                term = pc.fill_null(pc.index_in(coded.dictionary, terms), -1).to_numpy()[coded.indices.to_numpy(zero_copy_only=False)]
                starts = split.offsets.to_numpy().astype(np.int64)
                starts -= starts[0]
                at = np.flatnonzero(term >= 0)
                n = np.diff(np.searchsorted(at, starts))
                some = np.flatnonzero(n)
                pos = at - np.repeat(starts[:-1], n)
                ends = np.cumsum(n[some])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(some)), pa.array(np.diff(starts)[some].astype(np.int32)), packed(pos, ends), packed(term[at], ends)], names=["doc_id", "n_words", "pos", "term"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("text is not null")
    return rows.mapInArrow(run, "doc_id long, n_words int, pos binary, term binary")


def summed(parts: DataFrame, n: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of partial arrays (part int, data binary: float64), one row per task, in a tree with 8 branches: the driver gets at most 8 rows, each with RANK + EXTRA numbers for a term of the block (under 30 MB)."""

    def run(it):
        total, key = None, 0
        for batch in it:
            for k, d in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                a = np.frombuffer(d, np.float64)
                total, key = (a if total is None else total + a), k
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    while n > 8:
        n = -(-n // 8)
        parts = parts.withColumn("part", F.pmod("part", F.lit(n))).repartition(n, "part").mapInArrow(run, "part int, data binary")
    out = np.zeros(int(np.prod(shape)))
    for r in parts.select("data").collect():
        out += np.frombuffer(r["data"], np.float64)
    return out.reshape(shape)


def per_task(hits: DataFrame, start, add) -> DataFrame:
    """One row per task: add(total, pos, term, n_words) over its documents, from start()."""

    def run(it):
        total = start()
        for batch in it:
            for n, p, t in zip(batch.column("n_words").to_pylist(), batch.column("pos").to_pylist(), batch.column("term").to_pylist(), strict=True):
                add(total, np.frombuffer(p, np.int32), np.frombuffer(t, np.int32), n)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["part", "data"])

    return hits.select("n_words", "pos", "term").mapInArrow(run, "part int, data binary")


def document_frequency(hits: DataFrame, terms: int) -> np.ndarray:
    def add(total, pos, term, n):
        total[np.unique(term)] += 1

    return summed(per_task(hits, lambda: np.zeros(terms), add), hits.rdd.getNumPartitions(), (terms,))


def product(total: np.ndarray, term: np.ndarray, row: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> None:
    """total += A' (A basis), A's rows given as (row, term) occurrences in order of row, scaled to length 1 as if no term came twice."""
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    w = weight[term]
    size = np.diff(np.append(heads, len(row)))
    w = w / np.sqrt(np.repeat(np.add.reduceat(w * w, heads), size))
    y = np.add.reduceat(w[:, None] * basis[term], heads)
    order = np.argsort(term.astype(np.uint16) if len(weight) < 1 << 16 else term, kind="stable")  # 16 bits are sorted by digits
    own = np.repeat(np.arange(len(heads)), size)[order]
    t = term[order]
    heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    total[t[heads]] += np.add.reduceat(w[order][:, None] * y[own], heads)


def leading_directions(hits: DataFrame, items: Items, seed: int = 11) -> np.ndarray:
    """The first RANK right singular vectors of the TF-IDF matrix of all passages: randomised subspace iteration (Halko, Martinsson and Tropp 2011).

    Passages are the documents' successive runs of PASSAGE words. Every iteration is one pass that forms A'(A V) per task, a table of
    (terms of the block) x 72 numbers, and sums these in a tree.
    """
    d = len(items.term)
    width = min(RANK + EXTRA, d)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for _ in range(POWER):
        shared = hits.sparkSession.sparkContext.broadcast((items.weight, basis.astype(np.float32)))  # terms of a block x 72 numbers

        def run(it, shared=shared):
            weight, b = shared.value
            total = np.zeros(b.shape, np.float64)
            for batch in it:
                rows, terms, at, n = [], [], 0, 0
                for p, t in zip(batch.column("pos").to_pylist(), batch.column("term").to_pylist(), strict=True):
                    p, t = np.frombuffer(p, np.int32), np.frombuffer(t, np.int32)
                    some = np.flatnonzero(weight[t] > 0)
                    if not len(some):
                        continue
                    rows.append(p[some] // PASSAGE + at)
                    terms.append(t[some])
                    at = int(rows[-1][-1]) + 1
                    n += len(some)
                    if n > 20_000:
                        product(total, np.concatenate(terms), np.concatenate(rows), weight, b)
                        rows, terms, at, n = [], [], 0, 0
                if rows:
                    product(total, np.concatenate(terms), np.concatenate(rows), weight, b)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

        z = summed(hits.select("pos", "term").mapInArrow(run, "part int, data binary"), hits.rdd.getNumPartitions(), basis.shape)
        basis = np.linalg.qr(z)[0]
        shared.unpersist()
    return basis[:, :RANK]


def weighted_lcs(item: np.ndarray, text: np.ndarray, idf: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of two term sequences."""
    best = np.zeros(len(text) + 1, np.float32)
    for t in item:
        got = best.copy()
        here = np.flatnonzero(text == t)
        got[here + 1] = np.maximum(got[here + 1], best[here] + idf[t])
        best = np.maximum.accumulate(got)
    return float(best[-1])


def candidates(space: Space, local: np.ndarray, docs: list[tuple[int, np.ndarray, np.ndarray, int, int]], least_cos: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, first word, end, item, cosine) of every window whose cosine with an item of its length class is least_cos or more, window by window; windows whose product with the item shows that they have too little in common are left out.

    docs: (number, positions, terms, first block, end of the blocks that windows may start in) of pieces of documents;
    local: a term's number in the space, or -1. Steps are summed once, windows are sums of successive steps, and a class is one matrix product.
    """
    block, term, starts, at = [], [], [], 0
    for _, pos, t, first, _ in docs:
        here = local[t]
        some = np.flatnonzero(here >= 0)
        block.append(pos[some] // space.base - first + at)
        term.append(here[some])
        starts.append(at)
        at += (int(pos[-1]) // space.base - first) // space.most * space.most + space.most + -(-space.gap // space.most) * space.most
    block, term = np.concatenate(block), np.concatenate(term)
    if not len(block):
        return
    steps = np.zeros((at, space.latent.shape[1]), np.float32)
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    steps[block[heads]] = np.add.reduceat(space.latent[term], heads)
    starts = np.array(starts)
    numbers, firsts, ends = (np.array([d[c] for d in docs]) for c in (0, 3, 4))
    for step, n, items in space.classes:
        ratio = step // space.base
        own = steps if ratio == 1 else steps.reshape(-1, ratio, steps.shape[1]).sum(axis=1)
        windows = own[: len(own) - n + 1].copy()
        for k in range(1, n):
            windows += own[k : len(own) - n + 1 + k]
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", windows, windows)), 1e-9)
        cos = windows @ space.query[items].T
        w, k = np.nonzero((cos >= least_cos * norm[:, None]) & (cos >= space.low[items]))
        doc = np.searchsorted(starts, w * ratio, side="right") - 1
        block = w * ratio - starts[doc] + firsts[doc]
        ok = block < ends[doc]
        yield from zip(numbers[doc[ok]].tolist(), (block[ok] * space.base).tolist(), (block[ok] * space.base + n * step).tolist(), space.own[items[k[ok]]].tolist(), (cos[w, k] / norm[w])[ok].tolist(), strict=True)


def pieces_of(space: Space, docs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, int, int]]]:
    """Documents (positions, terms) in lists of about CHUNK_WORDS words for `candidates`; a longer one in pieces of CHUNK_BLOCKS steps that overlap by a window."""
    some, words = [], 0
    size = max(CHUNK_BLOCKS // space.most, 1) * space.most
    more = -(-space.gap // space.most) * space.most
    for k, (pos, term) in enumerate(docs):
        for first in range(0, int(pos[-1]) // space.base + 1, size):
            a, b = np.searchsorted(pos, (first * space.base, (first + size + more) * space.base))
            if a < b:
                some.append((k, pos[a:b], term[a:b], first, first + size))
                words += int(pos[b - 1]) - first * space.base + 1
            if words >= CHUNK_WORDS:
                yield some
                some, words = [], 0
    if some:
        yield some


def leaks(items: Items, docs: list[tuple[np.ndarray, np.ndarray]], least_lcs: float, para_lcs: float, answer: float, least_cos: float = LEAST_COS) -> list[tuple[int, int, float, float, float]]:
    """(document, item, cosine, LCS share, answer share) of the items that documents (positions, terms) hold: candidates of the cosine search that the subsequences confirm."""
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    weights = [items.idf[w] for w in items.words]
    need = (para_lcs * items.mass - 1e-3).tolist()
    here = np.zeros(len(items.idf), bool)  # the words of the window at hand
    for space in items.spaces:
        local = np.full(len(items.idf), -1, np.int32)
        local[space.terms] = np.arange(len(space.terms), dtype=np.int32)
        local[items.weight == 0] = -1
        for some in pieces_of(space, docs):
            last, text = None, np.zeros(0, np.int32)
            for doc, lo, hi, k, cos in candidates(space, local, some, least_cos):
                if last != (doc, lo, hi):
                    last, (pos, term) = (doc, lo, hi), docs[doc]
                    here[text] = False
                    text = term[pos.searchsorted(lo) : pos.searchsorted(hi)]
                    here[text] = True
                words = items.words[k]
                if weights[k][here[words]].sum() < need[k]:  # words in common bound the common subsequence
                    continue
                share = weighted_lcs(words, text, items.idf) / float(items.mass[k])
                if share < para_lcs:
                    continue
                tail = words[len(words) - items.answers[k] :]
                told = weighted_lcs(tail, text, items.idf) / float(items.idf[tail].sum())
                if share >= least_lcs or told >= answer:
                    out[doc, k] = max(out.get((doc, k), (0.0, 0.0, 0.0)), (cos, share, told), key=lambda x: x[1])
            here[text] = False
    return [(doc, items.ids[k], *v) for (doc, k), v in sorted(out.items())]


def contaminated(docs: DataFrame, bench: DataFrame, least_lcs: float = 0.75, para_lcs: float = 0.5, answer: float = 0.75, least_cos: float = LEAST_COS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, cosine, lcs_share, answer_share): the document holds the benchmark item.

    An item is a candidate in every window whose cosine with it in the latent space is least_cos; windows are at most
    three times as long as the items of a length class (one of up to 8 words: 16 words), at steps of half their length. A candidate is held if
    item and window have a common subsequence of least_lcs of the item's word weight, or, for a paraphrase,
    para_lcs of it and `answer` of the item's answer (its last sentence). Words weigh by their
    inverse document frequency in all documents. Documents and items that are null, empty or without a word
    match nothing; repeated rows each give their pairs, null ids give pairs with a null id. The benchmark is
    the query set, taken in blocks of bounded size; for each, the documents are read once.
    """
    spark = docs.sparkSession
    shape = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    out = spark.createDataFrame([], shape)
    n_docs = docs.count()
    for items in blocks_of(bench, item_col, item_text):
        if not items.ids:
            continue
        hits = cut(hits_of(docs, items, id_col, text_col), "hits")
        items.weigh(document_frequency(hits, len(items.term)), n_docs)
        items.place(leading_directions(hits, items), para_lcs)
        shared = spark.sparkContext.broadcast(items)  # BLOCK_CHARS characters: four spaces of some 10,000 terms x 320 numbers
        # the table of hits is small for the work it makes: more tasks than its files give
        tasks = max(4 * hits.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)

        def run(it, shared=shared):
            got = shared.value
            for batch in it:
                ids = batch.column("doc_id").to_pylist()
                texts = [(np.frombuffer(p, np.int32), np.frombuffer(t, np.int32)) for p, t in zip(batch.column("pos").to_pylist(), batch.column("term").to_pylist(), strict=True)]
                rows = [(ids[k], *x) for k, *x in leaks(got, texts, least_lcs, para_lcs, answer, least_cos)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        out = out.unionAll(hits.select("doc_id", "pos", "term").repartition(tasks).mapInArrow(run, shape))
    return out


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold an item; rows with a null id stay."""
    bad = contaminated(docs, bench, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__gone")).where("__gone is not null").distinct()
    return docs.join(bad, docs[id_col] == bad["__gone"], "left_anti")
