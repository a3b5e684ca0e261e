"""Mixing to target weights: iterative proportional fitting of token weights to marginals, then Poisson sampling. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Cells up to this many are raked in one task (about 100 bytes each) and broadcast to the documents; more are shuffled.
SMALL_CELLS = 500_000
#: Deviation of a level's share of the weights from its goal at which raking ends.
TOLERANCE = 1e-13
#: Rounds after which raking ends in any case.
ROUNDS = 100
NULL_LEVEL = "(null)"


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up; an empty or null text has none."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by plain signs in the whole text: legal, table, contact, numeric or prose."""
    t = F.coalesce(text, F.lit(""))
    has = t.contains
    return (
        F.when(has("icense") | has("opyright"), "legal").when(has("|"), "table").when(has("@") | has("http"), "contact").when(F.length(t) > 2 * F.length(F.translate(t, "0123456789", "")), "numeric").otherwise("prose")
    )


def target_shares(cells: DataFrame, dim: str, rule: float | dict[str, float]) -> DataFrame:
    """(dim, goal): shares that sum to 1 over the levels in the table.

    A number is a temperature: shares go as (tokens of the level) ** rule. A dict names shares;
    those of absent levels are dealt out in proportion, and levels it does not name get 0.
    """
    by = cells.groupBy(dim).agg(F.sum("w0").alias("n"))
    if isinstance(rule, dict):
        named = F.create_map(*[F.lit(x) for k, v in rule.items() for x in (k, float(v))])
        by = by.withColumn("goal", F.coalesce(F.element_at(named, F.col(dim)), F.lit(0.0)))
    else:
        by = by.withColumn("goal", F.pow(F.col("n"), F.lit(float(rule))))
    total = by.agg(F.sum("goal").alias("all"))
    return by.join(F.broadcast(total)).select(dim, F.when(F.col("all") > 0, F.col("goal") / F.col("all")).otherwise(F.lit(0.0)).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], tol: float = TOLERANCE, most: int = ROUNDS, every: int = 4) -> DataFrame:
    """cells (dims..., w0) with w: weights that keep w0's interactions and meet the targets' marginals (Deming and Stephan 1940).

    Every round scales the cells of each level of each dimension to its goal. After `every`
    rounds, then twice as many and so on up to 16, the marginals are compared with the goals; rounds end when all are met within tol of the whole, or, where targets and
    empty cells contradict each other, after `most` rounds with the last dimension's goals met. The table of cells
    is read from the shared folder and is one partition when small, so that no window
    needs an exchange; a larger one is dealt by the level.
    """
    small = cells.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS
    now = cells
    for d, rule in targets.items():
        goals = target_shares(cells, d, rule)
        now = now.join(F.broadcast(goals) if small else goals, d, "left").withColumnRenamed("goal", f"goal_{d}")
    now = cut(now.withColumn("w", F.col("w0").cast("double")), "cells")
    done = 0
    while done < most:
        now = now.coalesce(1) if small else now
        for _ in range(min(every, most - done)):
            for d in targets:
                total = F.sum("w").over(Window.partitionBy(d))
                now = now.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"goal_{d}") / total).otherwise(F.lit(0.0)))
        done, every = done + every, min(2 * every, 16)
        now = cut(now, "cells")
        off = [now.groupBy(d).agg(F.abs(F.sum("w") - F.first(f"goal_{d}")).alias("off")) for d in targets]
        worst = reduce(DataFrame.unionAll, [x.select("off") for x in off]).agg(F.max("off")).first()[0]
        if worst is None or worst <= tol:
            break
    return now.drop(*[f"goal_{d}" for d in targets])


def sampling_rates(cells: DataFrame, budget: float) -> DataFrame:
    """cells with p = min(1, c * w / w0), c such that the expected tokens are `budget` of all (or as many as the weights allow).

    With the cells that are taken whole known, c is what is left of the goal over the weight of the others; more cells
    may then be whole. c only grows and settles after as many steps as there are such moves, a few.
    """
    sums = cells.agg(F.sum("w0"), F.sum("w"), F.sum(F.when(F.col("w") > 0, F.col("w0")).otherwise(0))).first()
    total, mass, reach = (float(x or 0) for x in sums)
    goal = min(budget * total, reach)
    c = goal / mass if mass else 0.0
    while True:
        whole = F.lit(c) * F.col("w") >= F.col("w0")
        held, rest = cells.where("w > 0").agg(F.sum(F.when(whole, F.col("w0")).otherwise(F.lit(0.0))), F.sum(F.when(whole, F.lit(0.0)).otherwise(F.col("w")))).first()
        new = (goal - float(held or 0)) / float(rest) if rest else c
        if new <= c * (1 + 1e-14):
            break
        c = new
    return cells.withColumn("p", F.when((F.col("w0") > 0) & (F.col("w") > 0), F.least(F.lit(1.0), F.lit(c) * (F.col("w") / F.col("w0")))).otherwise(F.lit(0.0)))


def unit(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the id and the seed: 48 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"))), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mix(docs: DataFrame, targets: dict[str, float | dict[str, float]], dims: dict[str, Column], budget: float = 0.8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns mix_<dim>, mix_tokens, mix_p (probability) and mix_kept; no row is left out. Columns of docs that have these names are replaced.

    dims: level of a document in each dimension, null counting as the level '(null)'; targets: as
    in target_shares. Documents without tokens, and those of cells with goal 0, have p = 0. Equal
    ids get the same draw. Cells are pre-aggregated before their shuffle, so one source with a
    third of all rows is one row per task. An empty table gives no rows.
    """
    names = {d: f"mix_{d}" for d in dims}
    rows = docs.withColumns({names[d]: F.coalesce(c.cast("string"), F.lit(NULL_LEVEL)) for d, c in dims.items()} | {"mix_tokens": tokens_of(docs[text_col])})
    cells = cut(rows.groupBy(*names.values()).agg(F.sum("mix_tokens").alias("w0")).where("w0 > 0"), "cells")
    raked = rake(cells, {names[d]: targets[d] for d in dims})
    rates = sampling_rates(raked, budget).select(*names.values(), F.col("p").alias("mix_p"))
    if cells.count() <= SMALL_CELLS:
        rates = F.broadcast(rates)
    out = rows.drop("mix_p", "mix_kept").join(rates, list(names.values()), "left").withColumn("mix_p", F.when(F.col("mix_tokens") > 0, F.coalesce("mix_p", F.lit(0.0))).otherwise(F.lit(0.0)))
    return out.withColumn("mix_kept", F.coalesce(unit(F.col(id_col), seed) < F.col("mix_p"), F.lit(False)))


def standard_mix(docs: DataFrame, budget: float = 0.8) -> DataFrame:
    """The production mix: sources and topics flattened to the square root of their tokens, languages to the power 0.7."""
    return mix(docs, {"source": 0.5, "lang": 0.7, "topic": 0.5}, {"source": docs["source"], "lang": docs["lang"], "topic": topic_of(docs["text"])}, budget)


def standard_sql(budget: float = 0.8, rounds: int = ROUNDS, steps: int = 12, seed: int = 17) -> str:
    """The same in SQL: all rounds by recursion, the steps written out, more than it takes."""
    dims = {"mix_source": 0.5, "mix_lang": 0.7, "mix_topic": 0.5}
    parts = [
        f"""rows AS (SELECT doc_id, coalesce(source, '{NULL_LEVEL}') AS mix_source, coalesce(lang, '{NULL_LEVEL}') AS mix_lang,
  CASE WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'legal' WHEN contains(t, '|') THEN 'table'
    WHEN contains(t, '@') OR contains(t, 'http') THEN 'contact' WHEN length(t) > 2 * length(translate(t, '0123456789', '')) THEN 'numeric' ELSE 'prose' END AS mix_topic,
  CAST((strlen(t) + 3) // 4 AS BIGINT) AS mix_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "cells AS MATERIALIZED (SELECT mix_source, mix_lang, mix_topic, CAST(sum(mix_tokens) AS DOUBLE) AS w0 FROM rows GROUP BY ALL HAVING sum(mix_tokens) > 0)",
    ]
    for d, power in dims.items():
        parts.append(f"goal_{d} AS (SELECT {d}, n / sum(n) OVER () AS goal FROM (SELECT {d}, pow(sum(w0), {power}) AS n FROM cells GROUP BY 1))")
    parts.append("r0 AS MATERIALIZED (SELECT c.*, w0 AS w, a.goal AS g0, b.goal AS g1, d.goal AS g2 FROM cells c JOIN goal_mix_source a USING (mix_source) JOIN goal_mix_lang b USING (mix_lang) JOIN goal_mix_topic d USING (mix_topic))")
    inner = f"SELECT * FROM turns WHERE k < {rounds}"
    for k, d in enumerate(dims):
        inner = f"SELECT * REPLACE (w * g{k} / sum(w) OVER (PARTITION BY {d}) AS w) FROM ({inner})"
    parts.append(f"turns AS (SELECT *, 0 AS k FROM r0 UNION ALL SELECT * REPLACE (k + 1 AS k) FROM ({inner}))")
    parts.append(f"raked AS MATERIALIZED (SELECT * FROM turns WHERE k = {rounds})")
    parts.append(f"c0 AS MATERIALIZED (SELECT {budget} * sum(w0) / sum(w) AS c, {budget} * sum(w0) AS goal FROM raked)")
    for k in range(steps):
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT CASE WHEN rest > 0 THEN greatest(c, (goal - held) / rest) ELSE c END AS c, goal FROM (SELECT any_value(c) AS c, any_value(goal) AS goal, sum(CASE WHEN c * w >= w0 THEN w0 ELSE 0.0 END) AS held, sum(CASE WHEN c * w >= w0 THEN 0.0 ELSE w END) AS rest FROM raked, c{k}))")
    parts.append(f"rates AS (SELECT mix_source, mix_lang, mix_topic, least(1.0, c * (w / w0)) AS p FROM raked, c{steps})")
    return (
        "WITH RECURSIVE "
        + ",\n".join(parts)
        + f""" SELECT doc_id, mix_source, mix_lang, mix_topic, mix_tokens, CAST(floor(p * 1e6 + 0.5137) AS BIGINT) AS p_micro,
  coalesce(CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST(doc_id AS VARCHAR))), 1, 12) AS BIGINT) / 281474976710656.0 < p, false) AS kept
FROM (SELECT rows.*, CASE WHEN mix_tokens > 0 THEN coalesce(p, 0.0) ELSE 0.0 END AS p FROM rows LEFT JOIN rates USING (mix_source, mix_lang, mix_topic))"""
    )
