"""Line dedup: runs of lines that occurred before, found by distributed prefix doubling over line ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

NULL_ID = -(1 << 63)


def tied(rows: DataFrame) -> DataFrame:
    """rows (d, th, p, name) with `first`: the least place of the name; names that occur once are dropped.

    A name's count and least place come from partial aggregates, so a line that a third of the
    documents hold is one row per task; they are a table of their own, as adaptive execution splits a hot name only in a
    join of two plain exchanges.
    """
    names = rows.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("d", "th", "p")).alias("first")).where("n > 1")
    return rows.join(cut(names.select("name", "first"), "names"), "name")


def repeated_windows(now: DataFrame, run: int) -> DataFrame:
    """(d, th, p) of every window of `run` lines that also starts at a lesser place (d, th, p), given the tied lines.

    Prefix doubling: names of 1, 2, 4, ... lines; each round pairs a place's name with the one
    `length` further on (an offset join on the place), drops the places whose name is unique (no longer
    window there can repeat) and stops at the threshold; the last step overlaps if `run` is no
    power of two. What is left in the last round are the members of LCP intervals of at least
    `run` lines.
    """
    length = 1
    while length < run:
        step = min(length, run - length)
        after = now.select("d", "th", (F.col("p") - step).alias("p"), F.col("name").alias("tail"))
        pairs = now.join(after, ["d", "th", "p"]).select("d", "th", "p", F.unhex(F.md5(F.concat("name", "tail"))).alias("name"))
        length += step
        now = tied(cut(pairs, "pairs"))
    return now.where(F.struct("d", "th", "p") != F.col("first")).select("d", "th", "p")


def dedup_lines(docs: DataFrame, run: int = 2, lone: int | None = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, n_runs (maximal removed runs), kept (the lines that stay, joined by line feeds).

    Lines are what lies between line feeds (an empty text is one empty line, a null text is
    empty). A line goes if it lies in a window of `run` lines that starts at an earlier place
    too, or if it has `lone` characters or more (None: never) and stands at an earlier place itself: in a smaller
    doc_id, or further up in the same text; rows with the same id come in order
    of a hash of the text, and rows equal in id and text are one document. Null ids come first.
    Windows never cross documents and are judged on the input. An empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col).withColumn("d", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("th", F.xxhash64("text"))
    long_ = F.lit(False) if lone is None else F.length("line") >= lone
    lines = rows.select("d", "th", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("d", "th", "p", F.unhex(F.md5(F.col("line").cast("binary"))).alias("name"), long_.alias("alone")).distinct()
    seen = cut(tied(lines), "tied")
    by_itself = seen.where(F.col("alone") & (F.struct("d", "th", "p") != F.col("first"))).select("d", "th", "p", F.lit(1).alias("n"))
    windows = repeated_windows(seen, run).select("d", "th", "p", F.lit(run).alias("n"))
    hits = windows.unionAll(by_itself).groupBy("d", "th").agg(F.collect_list(F.struct("p", "n")).alias("starts"))  # a document's own places
    gone = rows.join(hits, ["d", "th"], "left").select("doc_id", "text", "starts")

    def run_docs(it):
        for batch in it:
            out = []
            for i, text, starts in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "starts")), strict=True):
                lines, runs, end, kept = text.split("\n"), 0, -1, []
                for p, n in sorted((x["p"], x["n"]) for x in starts or ()):
                    runs += p > end
                    kept += lines[max(end, 0) : p] if p > end else []
                    end = max(end, p + n)
                kept += lines[max(end, 0) :]
                out.append((i, len(lines), len(lines) - len(kept), runs, "\n".join(kept)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_lines", "n_removed", "n_runs", "kept"])

    return gone.mapInArrow(run_docs, "doc_id long, n_lines long, n_removed long, n_runs long, kept string")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS p, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
pairs AS (SELECT doc_id, p, line, lead(line) OVER (PARTITION BY doc_id ORDER BY p) AS tail FROM lines),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY line, tail ORDER BY doc_id, p) AS k FROM pairs WHERE tail IS NOT NULL) WHERE k > 1),
lone AS (SELECT doc_id, p FROM (SELECT doc_id, p, length(line) AS n, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS k FROM lines) WHERE k > 1 AND n >= 50),
gone AS (SELECT doc_id, p FROM hits UNION SELECT doc_id, p + 1 FROM hits UNION SELECT doc_id, p FROM lone),
marked AS (SELECT l.*, g.p IS NOT NULL AS out FROM lines l LEFT JOIN gone g USING (doc_id, p)),
runs AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM marked)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed, count(*) FILTER (head) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT out), '')) AS kept_sha256
FROM runs GROUP BY doc_id
"""
