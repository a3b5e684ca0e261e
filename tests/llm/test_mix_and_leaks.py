import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphduo.llm import decontamination, raking

from .tables import documents, empty, odd_texts, prose


def sources(spark, n=400):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["en", "en", "en", "fr", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}", 0, "u", 1) for i in range(n)]
    return spark.createDataFrame(rows, documents(spark, []).schema)


def test_raked_weights_meet_the_marginals(spark):
    docs = sources(spark)
    out = raking.mix(docs, {"source": 0.5, "lang": {"en": 0.5, "fr": 0.3, raking.NULL_LEVEL: 0.2}}, {"source": F.col("source"), "lang": F.col("lang")}, budget=0.2)
    cell = out.groupBy("mix_source", "mix_lang").agg(F.sum("mix_tokens").alias("n"), F.first("mix_p").alias("p")).toPandas()
    cell["t"] = cell["n"] * cell["p"]
    share = cell.groupby("mix_lang")["t"].sum() / cell["t"].sum()
    assert share["en"] == pytest.approx(0.5, abs=1e-3) and share["fr"] == pytest.approx(0.3, abs=1e-3)
    size = cell.groupby("mix_source")["n"].sum() ** 0.5
    got = cell.groupby("mix_source")["t"].sum()
    assert np.allclose(got / got.sum(), size / size.sum(), atol=1e-3)
    assert cell["t"].sum() == pytest.approx(0.2 * cell["n"].sum(), rel=1e-6)


def test_sampling_follows_the_probabilities(spark):
    out = raking.standard_mix(sources(spark, 2000), 0.6).toPandas()
    again = raking.standard_mix(sources(spark, 2000).repartition(7), 0.6).toPandas()
    assert set(out[out["mix_kept"]]["doc_id"]) == set(again[again["mix_kept"]]["doc_id"])
    assert out["mix_kept"].mean() == pytest.approx(out["mix_p"].mean(), abs=0.04)
    assert ((out["mix_p"] >= 0) & (out["mix_p"] <= 1)).all()


def test_the_scale_takes_cells_whole_until_the_budget_is_met(spark):
    rows = [(10.0, 50.0), (100.0, 30.0), (400.0, 20.0), (490.0, 1.0), (50.0, 0.0)]
    for budget in (0.05, 0.3, 0.5, 0.94, 1.0):
        got = raking.sampling_rates(spark.createDataFrame(rows, "w0 double, w double"), budget).collect()
        assert sum(r["p"] * r["w0"] for r in got) == pytest.approx(min(budget * 1050, 1000), rel=1e-12)
        part = [r["p"] * r["w0"] / r["w"] for r in got if 0 < r["p"] < 1]
        assert all(x == pytest.approx(part[0]) for x in part) and all(r["w"] / r["w0"] * part[0] >= 1 - 1e-12 for r in got if part and r["p"] == 1)


def test_raking_ends_when_the_goals_are_met_or_cannot_be(spark):
    cells = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 1.0), ("b", "x", 1.0), ("b", "y", 90.0)], "d string, e string, w0 double")
    got = {(r["d"], r["e"]): r["w"] for r in raking.rake(cells, {"d": {"a": 0.7, "b": 0.3}, "e": {"x": 0.5, "y": 0.5}}).collect()}
    assert got["a", "x"] + got["a", "y"] == pytest.approx(0.7, abs=1e-12) and got["a", "x"] + got["b", "x"] == pytest.approx(0.5, abs=1e-12)
    assert got["a", "x"] * got["b", "y"] / (got["a", "y"] * got["b", "x"]) == pytest.approx(5 * 90)
    against = raking.rake(cells.where("d = e or d = 'a' and e = 'x' or d = 'b' and e = 'y'"), {"d": {"a": 0.7, "b": 0.3}, "e": {"x": 0.5, "y": 0.5}}, most=8).collect()
    assert len(against) == 2 and sum(r["w"] for r in against) == pytest.approx(1)


def test_clashing_columns_are_replaced(spark):
    docs = sources(spark, 60)
    clash = docs.selectExpr("*", "'q' mix_source", "1 mix_p", "'no' mix_kept", "7 mix_tokens", "1 w0")
    one, two = (raking.standard_mix(d).select("doc_id", "mix_source", "mix_tokens", "mix_p", "mix_kept") for d in (docs, clash))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_main_path_is_native(spark):
    plan = raking.standard_mix(sources(spark, 20))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mix_of_odd_tables(spark):
    assert raking.standard_mix(empty(spark)).count() == 0
    got = raking.standard_mix(documents(spark)).collect()
    assert len(got) == len(odd_texts())
    assert all(r["mix_p"] == 0 and not r["mix_kept"] for r in got if not r["text"])
    rows = raking.standard_mix(documents(spark, ["a b c d", None, ""], [None, None, 1])).collect()
    assert len(rows) == 3 and not any(r["mix_kept"] for r in rows if not r["text"])
    assert len({r["mix_kept"] for r in rows if r["doc_id"] is None and r["text"]}) == 1
    zero = raking.mix(sources(spark, 50), {"lang": {"fr": 1.0}}, {"lang": F.col("lang")}, 0.9)
    assert zero.where("lang = 'en' and mix_kept").count() == 0


BENCH = "item_id long, text string, doc_id string"


def test_leaks_and_paraphrases(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [" ".join(word() for _ in range(rng.randint(12, 60))) + ". " + " ".join(word() for _ in range(6)) + "." for _ in range(30)]
    clean = [prose(rng, rng.randint(0, 400)) + " " + " ".join(word() for _ in range(20)) for _ in range(120)]
    texts, want = list(clean), set()
    for k, t in enumerate(items):
        w = t.split()
        if k % 3 == 0:
            put = t
        elif k % 3 == 1:  # a paraphrase: one word in six is another, the last sentence stays
            put = " ".join(x if j % 6 or j > len(w) - 7 else word() for j, x in enumerate(w))
        else:  # in upper case, over several lines
            put = t.upper().replace(" ", "\n")
        want.add((len(texts), k))
        texts.append(prose(rng, rng.randint(0, 300)) + " " + put + " " + prose(rng, rng.randint(0, 300)))
    texts.append(items[0].split(". ")[1])  # an answer alone is no leak
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(98, None, "x"), (99, "", "x"), (None, items[0], "x")], BENCH)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(documents(spark, texts, list(range(len(texts)))), bench).collect()}
    assert {g for g in got if g[1] is not None} == want
    kept = decontamination.clean(documents(spark, texts, list(range(len(texts)))), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_recall_by_item_length(spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [some(rng.randint(5, 63)) for _ in range(600)]
    texts, plants = [], []
    for d in range(120):
        words = some(30)
        for k in range(5 * d, 5 * d + 5):
            words += items[k] + some(40)
            plants.append((d, k))
        texts.append(words)
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)], BENCH)
    docs = documents(spark, [" ".join(w) for w in texts], list(range(len(texts))))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    for low, high in ((5, 10), (10, 20), (20, 30), (30, 64)):
        own = [p for p in plants if low <= len(items[p[1]]) < high]
        assert len(own) > 30 and all(p in got for p in own), (low, high, sum(p in got for p in own), len(own))
    # every item against every window of a few documents
    of = {w: k for k, w in enumerate(dict.fromkeys(w for i in items for w in i))}
    idf = weights_of(of, texts)
    for d in (0, 1):
        want = held(texts[d], [[of[w] for w in i] for i in items], of, idf)
        own = {k for e, k in got if e == d}
        assert own <= want and len(own) >= 0.9 * len(want) and len(want) >= 5


def weights_of(of, texts):
    df = np.zeros(len(of))
    for t in texts:
        df[[of[w] for w in set(t) if w in of]] += 1
    return (np.log((1 + len(texts)) / (1 + df)) + 0.1).astype(np.float32)


def held(words, items, of, idf):
    """Items whose common subsequence with some window of the text is long enough, without the cosine search."""
    text, out = np.array([of.get(w, -1) for w in words]), set()
    for k, i in enumerate(items):
        i = np.array(i)
        top = max(8, 1 << (len(i) - 1).bit_length())
        step = 8 if top == 8 else max(16, top // 2)
        for a in range(0, len(text), step):
            x = text[a : a + top + step]
            if idf[i[np.isin(i, x)]].sum() >= 0.5 * idf[i].sum() and (share := decontamination.weighted_lcs(i, x, idf) / idf[i].sum()) >= 0.5:
                tail = i[-3:]  # one sentence of no marks: the last three words at least, all of them here
                if share >= 0.75 or decontamination.weighted_lcs(i, x, idf) / idf[i].sum() >= 0.75 and len(tail):
                    out.add(k)
    return out


def test_recall_of_damaged_copies(spark):
    """Copies with every k-th word another, against all windows: 0.9 or more of those that the subsequences accept are found by the cosine."""
    rng = random.Random(13)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(6000)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(5, 120))] for _ in range(300)]
    texts = []
    for d in range(100):
        words = [rng.choice(vocab) for _ in range(50)]
        for k in range(3 * d, 3 * d + 3):
            every = rng.choice([5, 6, 8, 11])
            words += [w if (j + 1) % every else rng.choice(vocab) for j, w in enumerate(items[k])] + [rng.choice(vocab) for _ in range(60)]
        texts.append(words)
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)], BENCH)
    found = decontamination.contaminated(documents(spark, [" ".join(w) for w in texts], list(range(100))), bench).collect()
    of = {w: k for k, w in enumerate(dict.fromkeys(w for i in items for w in i))}
    idf = weights_of(of, texts)
    want = {(d, k) for d in range(0, 100, 4) for k in held(texts[d], [[of[w] for w in i] for i in items], of, idf)}
    got = {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] % 4 == 0}
    assert got <= want and len(want) > 50 and len(got) >= 0.9 * len(want)


def test_windows_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(300)]
    items = decontamination.Items([(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate((4, 12, 30, 30, 60, 130))])
    items.weigh(np.ones(len(items.term)), 1000)
    items.place(np.eye(len(items.term))[:, :5], 0.0)
    docs = []
    for n in (700, 3, 90, 2500):
        t = rng.integers(0, len(items.term), n)
        t[: min(n, 30)] = items.words[2][: min(n, 30)]
        docs.append((np.arange(n, dtype=np.int32), t.astype(np.int32)))

    def found():
        (space,) = items.spaces
        local = np.full(len(items.idf), -1, np.int32)
        local[space.terms] = np.arange(len(space.terms))
        return sorted((d, k, lo, hi, round(c, 4)) for some in decontamination.pieces_of(space, docs) for d, lo, hi, k, c in decontamination.candidates(space, local, some, 0.4) if lo <= docs[d][0][-1])

    whole = found()
    monkeypatch.setattr(decontamination, "CHUNK_BLOCKS", 16)
    monkeypatch.setattr(decontamination, "CHUNK_WORDS", 200)
    assert set(found()) == set(whole) and whole
    # the cosines are those of the projected windows, at least the plain ones
    space = items.spaces[0]
    for d, k, lo, hi, cos in whole[:40]:
        x = np.zeros(len(items.term))
        np.add.at(x, docs[d][1][lo:hi], items.weight[docs[d][1][lo:hi]])
        q = np.zeros(len(items.term))
        np.add.at(q, items.words[k], items.weight[items.words[k]])
        assert cos >= x @ q / np.linalg.norm(x) / np.linalg.norm(q) - 1e-3
        assert abs(np.linalg.norm(space.query[list(space.own).index(k)]) - 1) < 1e-4


def test_the_least_product_is_a_bound():
    rng = np.random.default_rng(6)
    items = decontamination.Items([(k, " ".join(f"w{j}" for j in rng.integers(0, 60, n))) for k, n in enumerate((5, 20, 40, 40))])
    items.weigh(rng.integers(1, 400, len(items.term)), 1000)
    items.place(np.zeros((len(items.term), 2)), 0.5)
    (space,) = items.spaces
    for at, k in enumerate(space.own):
        words, q = items.words[k], np.bincount(items.words[k], items.weight[items.words[k]], len(items.term))
        for _ in range(300):
            some = words[rng.random(len(words)) < rng.uniform(0.2, 1)]
            if items.idf[some].sum() >= 0.5 * items.mass[k]:
                assert np.bincount(some, items.weight[some], len(items.term)) @ q / np.linalg.norm(q) >= space.low[at]


def test_common_subsequences():
    idf = np.array([1, 2, 3, 4], np.float32)

    def plain(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + idf[x] if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 12))
        assert decontamination.weighted_lcs(a, b, idf) == pytest.approx(plain(a, b))


def test_leaks_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", "x")], BENCH)
    assert decontamination.contaminated(empty(spark), bench).count() == 0
    assert decontamination.contaminated(documents(spark), bench.limit(0)).count() == 0
    rows = decontamination.contaminated(documents(spark, ["alpha beta gamma delta epsilon zeta", None, "", "alpha beta gamma delta epsilon zeta"], [None, 1, 2, 2]), bench).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["2", "None"]


def test_leading_directions_are_those_of_the_passages(spark):
    rng = random.Random(8)
    topics = [[f"t{g}x{k}" for k in range(30)] for g in range(5)]
    items = decontamination.Items([(g, " ".join(topics[g])) for g in range(5)])
    texts = [" ".join(rng.choice(topics[d % 5 if d % 7 else 0]) for _ in range(100 + d)) for d in range(60)]
    hits = decontamination.hits_of(documents(spark, texts, list(range(60))), items, "doc_id", "text").persist()
    items.weigh(decontamination.document_frequency(hits, len(items.term)), 600)
    got = decontamination.leading_directions(hits, items)
    assert np.allclose(got.T @ got, np.eye(got.shape[1]), atol=1e-8)
    rows = []
    for t in texts:
        ws = [items.term[w] for w in t.split()]
        for lo in range(0, len(ws), decontamination.PASSAGE):
            w = items.weight[ws[lo : lo + decontamination.PASSAGE]]
            rows.append(np.bincount(ws[lo : lo + decontamination.PASSAGE], w, len(items.term)) / np.sqrt((w * w).sum()))
    vt = np.linalg.svd(np.array(rows), full_matrices=False)[2]
    for v in vt[:5]:  # one for each topic
        assert np.linalg.norm(got.T @ v) > 0.999


def test_a_long_text_with_a_filled_benchmark(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(900)]
    items = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(30)]
    words = [rng.choice(vocab) for _ in range(60_000)]
    words[31_000:31_000], words[59_990:59_990] = items[3].split(), items[7].split()
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(99, " ".join(words[100:9_000]), "x")], BENCH)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(documents(spark, [" ".join(words), "short " + items[5], None], [1, 2, 3]), bench).collect()}
    assert got == {(1, 3), (1, 7), (1, 99), (2, 5)}
