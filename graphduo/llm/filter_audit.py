"""Filter interaction audit: what every order of a set of filters removes, step by step, by a first-failure lookup."""

from __future__ import annotations

from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
CELLS = len(ORDERS) * STEPS
MEASURES = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Parts whose arrays a task holds before it sends them on.
HELD_PARTS = 256
CAPITALS = bytes(range(65, 91))
SIGNS = b"#$%&*|"
CONTINUATION = bytes(range(128, 192))
DUPLICATE = 1 << FILTERS.index("E")


def first_failures() -> np.ndarray:
    """[pattern, order]: at which step, from 0, a document that fails the filters of the pattern's bits goes; STEPS if at none."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            fails = np.arange(1 << STEPS) >> FILTERS.index(order[step]) & 1 == 1
            table[fails, o] = step
    return table


def text_pattern(text: bytes) -> int:
    """Bits of A to D for a text in UTF-8. bytes.split and the byte sets know ASCII only, as the conditions do."""
    words = text.split()
    points = len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * points) << 2 | (len(text.translate(None, SIGNS)) < len(text)) << 3


def marked(docs: DataFrame, part_col: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, pattern of A to D, 128-bit digest of the text): a narrow row per document."""

    def run(it):
        for batch in it:
            pattern, digest = [], []
            for text in batch.column("text").cast(pa.binary()):
                raw = text.as_py()
                pattern.append(text_pattern(raw))
                digest.append(blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(pattern, pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "part", "pattern", "digest"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(run, "doc_id long, part string, pattern int, digest binary")


def patterns(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, pattern of A to E, good, toxic, n): documents by what they fail.

    E needs the least id of each text. Copies are counted by (text, part, pattern, labels) before
    they meet, so a text that a third of all documents share is a few rows when its group is looked at.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (F.coalesce(labels["quality"], F.lit(0)) == 1).alias("good"), (F.coalesce(labels["toxic"], F.lit(0)) == 1).alias("toxic"))
    known = known.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    kinds = ["digest", "part", "pattern", "good", "toxic"]
    rows = marked(docs, part_col, id_col, text_col).groupBy("digest", "part", "pattern", "doc_id").agg(F.count("*").alias("c"))  # rows of one id and text
    at = F.coalesce("doc_id", F.xxhash64("digest", "part"))  # null ids have no label, and do not all go to one task
    met = rows.withColumn("at", at).join(known.select(F.col("doc_id").alias("at"), F.lit(True).alias("labelled"), "good", "toxic"), "at", "left")
    has = F.col("doc_id").isNotNull() & F.col("labelled").isNotNull()
    met = met.select("digest", "part", "pattern", "doc_id", "c", (has & F.col("good")).alias("good"), (has & F.col("toxic")).alias("toxic"))
    same = met.groupBy(*kinds).agg(F.sum("c").alias("n"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("unnamed"))
    least = F.min("least").over(Window.partitionBy("digest"))
    stays = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = same.withColumn("first", least).withColumn("stays", stays)
    both = split.select("part", "good", "toxic", F.explode(F.array(F.struct("pattern", F.col("stays").alias("n")), F.struct((F.col("pattern") + DUPLICATE).alias("pattern"), (F.col("n") - F.col("stays")).alias("n")))).alias("x"))
    return both.select("part", "x.pattern", "good", "toxic", "x.n").where("n > 0")


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", held: int = HELD_PARTS) -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters A (under 200 words), B (under half of the words distinct), C (over 2 % capitals), D (a sign of
    #$%&*|), E (the text of a smaller doc_id, anywhere in the table). A null text is empty, a null part the empty
    string. Null ids are neither smaller nor larger than others: their rows never fail E, and make none
    fail it. Rows equal in id and text fail or pass E together; each counts. A document is good or toxic if any of its rows of
    labels says so; one without a row, or with nulls in it, is neither. Columns of other names are not read. Empty tables: no documents, no rows; no labels, none lost.
    """
    table = first_failures()
    letters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])  # [order, step]: the filter
    names = [*MEASURES, "n"]

    def run(it):
        def sent(parts, sums):
            cols = [pa.array(list(parts), pa.string())]
            for m in MEASURES:
                cols.append(pa.array(list(sums[m][: len(parts)].reshape(len(parts), CELLS)), pa.list_(pa.int64())))
            cols.append(pa.array(sums["n"][: len(parts)].tolist(), pa.int64()))
            return pa.RecordBatch.from_arrays(cols, names=["part", *names])

        def empty():
            return {}, {m: np.zeros((held, CELLS), np.int64) for m in MEASURES} | {"n": np.zeros(held, np.int64)}

        parts, sums = empty()
        cell = np.arange(len(ORDERS)) * STEPS
        for batch in it:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "pattern", "good", "toxic", "n")), strict=True))
            for lo in range(0, len(rows), held):
                some = rows[lo : lo + held]
                if len(parts) + len({r[0] for r in some} - parts.keys()) > held:
                    yield sent(parts, sums)
                    parts, sums = empty()
                at = np.array([parts.setdefault(r[0], len(parts)) for r in some])
                pattern, good, toxic, n = (np.array([r[k] for r in some], np.int64) for k in range(1, 5))
                gone = table[pattern]  # [row, order]: the step
                where = np.where(gone < STEPS, at[:, None] * CELLS + cell + gone, held * CELLS)
                for m, weights in (("removed", n), ("good_lost", n * good), ("toxic_lost", n * toxic)):
                    sums[m] += binned(where, np.repeat(weights, len(ORDERS)), held)
                fails = pattern[:, None, None] >> letters & 1 == 1  # [row, order, step]
                later = fails & (np.arange(STEPS) > gone[:, :, None])
                alone = pattern[:, None, None] == 1 << letters
                every = at[:, None] * CELLS + np.arange(CELLS)
                for m, holds in (("redundant", later), ("unique_fails", alone)):
                    sums[m] += binned(np.where(holds.reshape(len(some), CELLS), every, held * CELLS), np.repeat(n, CELLS), held)
                sums["n"] += np.bincount(at, weights=n, minlength=held).astype(np.int64)
        if parts:
            yield sent(parts, sums)

    shape = "part string, " + ", ".join(f"{m} array<long>" for m in MEASURES) + ", n long"
    partial = patterns(docs, labels, part_col, id_col, text_col).mapInArrow(run, shape)
    cells = partial.select("part", "n", F.posexplode(F.arrays_zip(*MEASURES)).alias("cell", "x")).groupBy("part", "cell").agg(F.sum("n").alias("n"), *[F.sum(f"x.{m}").alias(m) for m in MEASURES])
    orders = F.array(*[F.lit(o) for o in ORDERS])
    named = cells.select("*", F.get(orders, F.floor(F.col("cell") / STEPS).cast("int")).alias("filter_order"), (F.col("cell") % STEPS + 1).cast("int").alias("step"))
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    of_filter = F.sum("removed").over(Window.partitionBy("part", F.substr("filter_order", F.col("step"), F.lit(1))))
    return named.select("part", "filter_order", "step", (F.col("n") - so_far).alias("kept"), *MEASURES, of_filter.alias("shapley"))


def binned(where: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Sums of the weights by cell, as [part, cell]; the last bin holds what belongs nowhere. Exact below 2^53 a call."""
    return np.bincount(where.ravel(), weights=weights, minlength=parts * CELLS + 1)[:-1].astype(np.int64).reshape(parts, CELLS)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fails FROM w),
k AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN k USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(substr(filter_order, CAST(step AS INTEGER), 1)) - 64 AS filter FROM o, range(1, 6) r(step)),
g AS (SELECT part, n, good, toxic, fails, filter_order, step, filter, fails[filter] AS fails_it, len(list_filter(fails, lambda x: x)) AS many,
  coalesce(bool_or(fails[filter]) OVER (PARTITION BY part, fails, good, toxic, filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM c, s),
t AS (SELECT part, filter_order, step, filter, sum(n) FILTER (NOT gone AND NOT fails_it) AS kept, sum(n) FILTER (NOT gone AND fails_it) AS removed, sum(n) FILTER (gone AND fails_it) AS redundant,
  sum(n) FILTER (fails_it AND many = 1) AS unique_fails, sum(n) FILTER (NOT gone AND fails_it AND good) AS good_lost, sum(n) FILTER (NOT gone AND fails_it AND toxic) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley FROM t
"""
