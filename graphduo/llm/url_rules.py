"""URL filter: a trie over reversed host labels and path segments, the longest rule decides."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a broadcast trie holds at most (some 500 bytes each in a Python worker); more go by joins.
TRIE_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict) of the standard list.
STANDARD = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case, and then up to `?`, `#` or the end; both empty for null and without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


class Trie:
    """Rules by reversed host labels; at a host, by whole path segments, and by the beginning of the next segment.

    A node is [children by label, paths or None]; paths are [children by segment, {beginning: rule},
    lengths of the beginnings from the longest, rule of the bare host or None].
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = [{}, None]
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = at = node[1] or [{}, {}, [], None]
            found = (host + path, verdict)
            if not path:
                at[3] = stricter(at[3], found)
                continue
            *whole, begin = path[1:].split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}, [], None])
            at[1][begin] = stricter(at[1].get(begin), found)
            at[2] = sorted({len(b) for b in at[1]}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the rule with most host labels that fits, of these the longest path."""
        node, best = self.root, None
        segments = path[1:].split("/") if path else None
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1]:
                best = self.on_path(node[1], segments) or best
        return best

    @staticmethod
    def on_path(at: list, segments: list[str] | None) -> tuple[str, str] | None:
        best = at[3]
        for segment in segments or ():
            for n in at[2]:
                if len(segment) >= n and (found := at[1].get(segment[:n])):
                    best = found
                    break
            at = at[0].get(segment)
            if at is None:
                break
        return best


def stricter(one: tuple[str, str] | None, other: tuple[str, str]) -> tuple[str, str]:
    return one if one and one[1] == "block" else other


def rule_table(rules: DataFrame) -> DataFrame:
    """rules with hosts in lower case; one row for each (host, path), block before allow. Rows with a null are ignored."""
    clean = rules.select(F.translate(rules["host"], UPPER, LOWER).alias("host"), rules["path"].alias("path"), rules["verdict"].alias("verdict")).na.drop()
    bad = clean.where("host = '' or verdict not in ('allow', 'block') or (path <> '' and not startswith(path, '/'))").limit(1).collect()
    if bad:
        raise ValueError(f"no rule of host, path from the slash on (or none), allow or block: {bad[0]}")
    return clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int = TRIE_RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule (host and path of the rule, or null), verdict (its, or `default`).

    A rule fits its host and all subdomains where the path starts with the rule's. Of the rules that fit,
    that with most host labels decides, of these the one with the longest path; a host and path both allowed and blocked is
    blocked. A null url, one without `://` and one without a host fit no rule. Ids may be null or repeat; other columns are not read;
    an empty table gives no rows, without rules every row gets the default. Up to `most` rules are a trie in every task, more are joined.
    """
    table = rule_table(rules)
    host, path = split_url(pages[url_col])
    urls = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    few = table.limit(most + 1).collect()
    if len(few) > most:
        return by_joins(urls, table, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie((r["host"], r["path"], r["verdict"]) for r in few))

    def run(it):
        find = trie.value.find
        for batch in it:
            found = [find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            rule, verdict = pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, f"page_id {urls.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def by_joins(urls: DataFrame, table: DataFrame, default: str) -> DataFrame:
    """judge for any number of rules: the trie's paths as rows. Distinct (host, path) meet rules by host suffix and whole segments.

    Every distinct pair gives a row for each host suffix and each depth of its path, so a rule that all
    hosts fit meets them on their path's segments as well; the pairs are told apart by 16 salts where they meet it.
    """
    salts = 16
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]', -1))), n -> array_join(slice(split(host, '[.]', -1), -n, n), '.'))")
    depths = F.expr("case when path = '' then array('') else concat(array(''), transform(sequence(1, size(split(path, '/', -1)) - 1), n -> concat(array_join(slice(split(path, '/', -1), 1, n), '/'), '/'))) end")
    own = F.expr("case when path = '' then '' else regexp_extract(path, '^.*/', 0) end")
    pairs = urls.select("host", "path").distinct().where("host <> ''").withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int"))
    probes = pairs.withColumn("suffix", F.explode(suffixes)).withColumn("whole", F.explode(depths))
    keyed = table.select(F.col("host").alias("suffix"), F.col("path").alias("p"), "verdict", own.alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    fits = probes.join(keyed, ["suffix", "whole", "salt"]).where("startswith(path, p)")
    rank = F.struct(F.size(F.split("suffix", "[.]", -1)), F.length("p"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "p").alias("rule"), "verdict"), rank).alias("best"))
    hosts = urls.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    spread = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return hosts.join(spread, ["host", "path", "salt"], "left").select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def standard_rules(spark) -> DataFrame:
    return spark.createDataFrame(STANDARD, "host string, path string, verdict string")


SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {', '.join(str(r) for r in STANDARD)}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
urls AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM named),
pairs AS (SELECT DISTINCT host, path FROM urls),
best AS (SELECT host, path, arg_max(rhost || rpath, length(rhost) * 100000 + length(rpath)) AS rule, arg_max(rverdict, length(rhost) * 100000 + length(rpath)) AS verdict
  FROM pairs JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (host, path)
"""
