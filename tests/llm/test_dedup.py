import collections
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from graphduo.llm import common, line_runs, probminhash, suffix_dedup

from .tables import documents, empty, odd_texts, prose


def jp(a, b):
    sa, sb = sum(a.values()), sum(b.values())
    every = set(a) | set(b)
    return sum(1 / sum(max((a.get(e, 0) / sa) / (a[d] / sa), (b.get(e, 0) / sb) / (b[d] / sb)) for e in every) for d in set(a) & set(b))


def weights(text):
    w = re.findall(r"\w+", text.lower())
    out = defaultdict(int)
    for k in range(max(1, len(w) - 4) if w else 0):
        out[tuple(w[k : k + 5])] += 1
    return out


def plain_classes(texts, ids):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ws = [weights(t or "") for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or ws[i] and ws[j] and jp(ws[i], ws[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(texts))]


def test_probability_jaccard_is_exact_and_estimated():
    codes = probminhash.WordCodes()
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    b = a[: len(a) // 2] + b[len(b) // 2 :]
    for x, y in ((a, b), (a + " " + a, b), (a, a), (a, "nothing in common here at all")):
        assert probminhash.probability_jaccard(probminhash.shingles(x, codes), probminhash.shingles(y, codes)) == pytest.approx(jp(weights(x), weights(y)))
    sets = [probminhash.shingles(t, codes) for t in (a + " " + a, b)]
    regs = probminhash.registers(sets, 4096)
    assert (regs[0] == regs[1]).mean() == pytest.approx(probminhash.probability_jaccard(*sets), abs=0.03)


def test_classes_against_all_pairs(spark):
    rng = random.Random(4)
    texts = odd_texts()
    for n in (60, 90):
        base = prose(rng, n).split()
        for _ in range(12):  # a group of near copies that differ in several words
            t = list(base)
            t[rng.randrange(len(t))] = "changed"
            texts.append(" ".join(t))
        step = list(base)
        for k in range(6):  # a chain: neighbours are alike, the ends are not
            step[(7 * k) % len(step)] = f"w{k}"
            texts.append(" ".join(step))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(documents(spark, texts, ids).repartition(3)).collect()}
    assert [got[i] for i in ids] == plain_classes(texts, ids)


def members_of(spark, rows, blocks):
    """rows (uid, comp, text, codes) of bucket 9 of band 1, whose leader is uid 0."""
    words = probminhash.WordCodes()
    sets = [probminhash.shingles(t, words, 1) for _, _, t, _ in rows]
    return spark.createDataFrame(
        [(1, 9, u, c, 0, blocks, codes, e.tobytes(), n.astype("<u4").tobytes()) for (u, c, _, codes), (e, n) in zip(rows, sets, strict=True)],
        "band int, code long, uid long, comp long, lead long, blocks int, codes array<long>, elements binary, counts binary",
    )


def test_links_that_miss_the_least_member_are_found(spark):
    rows = [(0, 0, "x y z", [1, 9]), (1, 1, "a b c d e", [2, 9]), (2, 2, "a b c d f", [3, 9]), (3, 3, "a b c d f", [3, 9]), (4, 1, "a b c d", [4, 9])]
    got = {tuple(r)[:2] for r in probminhash.rest_of_buckets(members_of(spark, rows, 1), 0.6).collect()}
    assert got in ({(2, 1), (3, 1)}, {(2, 1), (4, 3)})  # 2 and 3 share an earlier band, 1 and 4 are one component


@pytest.mark.parametrize("blocks", [1, 3])
def test_blocks_link_each_component_and_give_few_rows(spark, blocks):
    rng = random.Random(5)
    base = [[f"v{g}w{k}" for k in range(20)] for g in range(4)]
    rows = []
    for u in range(1, 161):
        w = list(base[u % 4])
        w[rng.randrange(20)] = f"u{u}"
        rows.append((u, u, " ".join(w), [u, 9]))
    got = probminhash.rest_of_buckets(members_of(spark, rows, blocks), 0.8).collect()
    of = {r[0]: collections.Counter(r[2].split()) for r in rows}
    assert all(r["similarity"] == pytest.approx(jp(of[r["a"]], of[r["b"]])) and r["similarity"] >= 0.8 for r in got)
    links = spark.createDataFrame([tuple(r)[:2] for r in got], "a long, b long")
    comp = {r["node"]: r["comp"] for r in common.components(links).collect()}
    want = [(x, y) for x in of for y in of if x < y and jp(of[x], of[y]) >= 0.8]
    assert want and all(comp[x] == comp[y] for x, y in want)
    assert len(got) <= 159 * blocks * (blocks + 1) / 2


def test_columns_of_classes(spark):
    assert probminhash.classes(documents(spark, ["a b c"], [3])).columns == ["doc_id", "class_id", "class_size", "joining_links"]


def test_classes_of_odd_tables(spark):
    assert probminhash.classes(empty(spark)).count() == 0
    rows = probminhash.classes(documents(spark, ["a b c", "a b c", "a b c", "x y"], [3, 3, None, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in rows) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    kept = probminhash.keep_one(documents(spark, ["a b c", "a b c", "a b c", "q"], [3, 3, 5, None]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "None"]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 200)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    got = {r["node"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 200)} | {300: 300, 301: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated byte strings ----------------------------------------------------------------------------


def plain_bytes(texts, ids):
    where = defaultdict(set)
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                where[b[k : k + 50]].add(i)
    least = {k: min(v) for k, v in where.items()}
    out = []
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49 if i is not None else 0):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def byte_cases():
    rng = random.Random(9)
    passage, short, edge = prose(rng, 30)[:120], prose(rng, 20)[:49], prose(rng, 20)[:50]
    texts = odd_texts()
    for _ in range(25):
        t = prose(rng, rng.randint(0, 40))
        at = rng.randint(0, len(t))
        texts.append(t[:at] + rng.choice([passage, passage[20:90], short, edge, "", passage + passage]) + t[at:])
    texts += [passage, edge, short, passage * 3, edge, "y" * 60, "y" * 49, "z" + "y" * 55]
    return texts


def test_bytes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    texts = byte_cases()
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup(documents(spark, texts, ids).repartition(3)).collect()}
    assert [got[i] for i in ids] == plain_bytes(texts, ids)


def test_minimizers_do_not_depend_on_slices(monkeypatch):
    b = np.frombuffer(prose(random.Random(3), 2000).encode(), np.uint8)
    whole = suffix_dedup.minimizers(b)
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    cut = suffix_dedup.minimizers(b)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    assert np.diff(whole[0]).max() <= 26


@pytest.mark.parametrize("parts", [1, 7, 211])
def test_each_bucket_has_a_partition_of_its_own(spark, parts):
    number = suffix_dedup.bucket_numbers(parts)
    rows = spark.createDataFrame([(int(x),) for x in number], "bucket int").repartition(parts, "bucket").selectExpr("bucket", "spark_partition_id() p").collect()
    assert {r["bucket"]: r["p"] for r in rows} == {int(x): k for k, x in enumerate(number)}


def test_bytes_of_odd_tables(spark):
    assert suffix_dedup.dedup(empty(spark)).count() == 0
    t = prose(random.Random(5), 30)
    texts, ids = [t, t, t + " and more", t, "q", None], [4, 4, 4, None, None, 9]
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in suffix_dedup.dedup(documents(spark, texts, ids)).collect())
    want = sorted((str(i), *row) for i, row in zip(ids, plain_bytes(texts, ids), strict=True))
    assert got == want
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.kept_texts(documents(spark, [t, "x " + t, t], [1, 2, 3])).collect()}
    assert kept == {1: t.encode(), 2: b"x ", 3: b""}


# --- lines --------------------------------------------------------------------------------------------


def plain_lines(texts, ids, run, lone):
    seen, alone, out = set(), set(), {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for k in range(len(lines) - run + 1):
            w = tuple(lines[k : k + run])
            if w in seen:
                gone[k : k + run] = [True] * run
            seen.add(w)
        for k, line in enumerate(lines):
            if lone is not None and len(line) >= lone and line in alone:
                gone[k] = True
            alone.add(line)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(lines), sum(gone), runs, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("run", "lone"), [(1, None), (2, None), (3, 3), (5, None), (2, 50)])
def test_lines_against_a_dictionary(spark, run, lone):
    rng = random.Random(run)
    long_ = [prose(rng, 12).replace("\n", " ") for _ in range(3)]
    texts = odd_texts() + ["\n".join(rng.choice(["a", "b", "c", "", "d e", *long_]) for _ in range(rng.randint(1, 14))) for _ in range(40)] + [long_[0], long_[0]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: tuple(r)[1:] for r in line_runs.dedup_lines(documents(spark, texts, ids), run, lone).collect()}
    assert got == plain_lines(texts, ids, run, lone)


def test_lines_of_odd_tables(spark):
    assert line_runs.dedup_lines(empty(spark)).count() == 0
    rows = line_runs.dedup_lines(documents(spark, ["a\nb", "a\nb", "a\nb\nc", None], [2, 2, 3, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in rows) == [("2", 0, "a\nb"), ("2", 0, "a\nb"), ("3", 2, "c"), ("None", 0, "")]
