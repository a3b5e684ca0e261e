"""URL rules, ranked search and the filter audit against plain versions."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from graphduo.llm import block_max, filter_audit, queries, url_rules

from .tables import documents, empty, odd_texts

SF = "/root/testdata/sf0.001"

# --- URL rules ----------------------------------------------------------------------------------------

URLS = [
    None, "", "example.org/es/x", "://", "http://", "http:///es/", "http://example.org/es/a", "http://EXAMPLE.Org/es/a?x=/de/", "http://example.org/es", "https://a.b.example.org/en/12/x#y", "http://example.org/en/2",
    "http://notexample.org/es/", "http://example.com", "http://example.com/", "http://com/fr/", "http://x.com/fr/#/de/", "http://x.com/de/?q", "http://x.com?/de/", "http://x.com#/de/", "http://x.net/de/", "http://.org/", "http://org./", "ftp://u:p@x.org:80/z",
    "http://x.com/FR/", "http://x.com/de//fr/", "a://b://c.org/", "http://ünï.org/é", "http://x.com/" + "a/" * 3000, "http://" + "a." * 500 + "org/x", "http://x.com/de/\n", "HTTP://X.COM/DE/", "http://x.com/de/", "http://x.com/de/", "http://İ.org/a",
]


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_judge(url, rules, default="allow"):
    host, path = plain_split(url)
    fits = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


MORE = [*url_rules.STANDARD, ("x.com", "", "block"), ("x.com", "/de/", "allow"), ("x.com", "/de/", "block"), ("example.org", "/en/12/", "allow"), ("a.b.example.org", "", "allow"), ("net", "/d", "block"), ("net", "/de", "allow"), ("net", "/de/a/b", "block")]


def rule_rows(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


@pytest.mark.parametrize("most", [1000, 0])
@pytest.mark.parametrize("rules", [url_rules.STANDARD, MORE, []])
def test_urls_are_judged_as_by_trying_every_rule(spark, rules, most):
    pages = spark.createDataFrame([(None if i == 3 else i // 2, u, "x", "y", "z") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string, verdict string").repartition(3)
    got = url_rules.judge(pages, rule_rows(spark, rules), most=most, default="block")
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(None if i == 3 else i // 2, *plain_judge(u, rules, "block")) for i, u in enumerate(URLS)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_random_urls_and_rules(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + "xy"[rng.random() < 0.4] * rng.randint(0, 2) for _ in range(rng.randint(0, 3)))
    rules = [(host(), path(), rng.choice(("allow", "block"))) for _ in range(60)]
    urls = [f"http://{host()}{path()}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [(i, *plain_judge(u, rules)) for i, u in enumerate(urls)]
    for most in (1000, 10):
        assert sorted(map(tuple, url_rules.judge(pages, rule_rows(spark, rules), most=most).collect())) == want


def test_rules_are_checked_and_empty_tables_give_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(pages, url_rules.standard_rules(spark)).count() == 0
    for bad in (("", "/", "allow"), ("org", "x", "allow"), ("org", "/", "maybe")):
        with pytest.raises(ValueError):
            url_rules.judge(pages, rule_rows(spark, [bad]))
    one = spark.createDataFrame([(1, "http://A.org/x")], "page_id long, url string")
    assert url_rules.judge(one, rule_rows(spark, [(None, "/", "block"), ("ORG", None, "block"), ("oRg", "/", "block")])).first()["rule"] == "org/"


def test_op11_over_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    assert sorted(map(tuple, queries.op11_url_rules(spark, SF).collect())) == sorted((p["page_id"], *plain_judge(p["url"], url_rules.STANDARD)) for p in pages)


# --- search -------------------------------------------------------------------------------------------

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        query, scored = Counter(plain_terms(text)), []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * n // length
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in query.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("segment", [1, 3000, 1 << 20])
def test_search_equals_scoring_every_document(spark, segment):
    texts = [*odd_texts(), *odd_texts(1), "River stone RIVER ÜBER", "river", "river", "stone river"]
    ids = [None, None, *range(7, 2 * len(texts) + 1, 2), 7]
    docs = documents(spark, texts, ids).repartition(3)
    items = [(1, "the green river"), (1, "the green river"), (1, "river river"), (2, None), (None, "STONE l'eau"), (3, "nothing-here zzz"), (4, odd_texts()[14]), (5, "x " + "中文 " * 3), (6, odd_texts()[20])]
    table = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, score int")
    got = block_max.search(block_max.build(docs, segment=segment), table, lead=2).collect()
    same(got, plain_search(list(zip(ids, texts, strict=True)), items))


def test_long_posting_lists_of_many_blocks(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 60)))) for i in range(2500)]
    docs[1700] = (1700, "w0 " * 70000 + "w59")  # a document past one and two bytes of a frequency
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(40)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = block_max.search(block_max.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), segment=40_000), table).collect()
    same(got, plain_search(docs, items))


def test_blocks_below_the_threshold_stay_compressed():
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=40))) for i in range(4000)]
    docs[2000] = (2000, "zz yy xx ww")
    got = block_max.encode_segment(docs, 4000, 160_000)
    segment = block_max.Segment(*(got[c] for c in ("docs", "terms", "counts", "firsts", "blocks", "postings")))
    query = [(t, 5000) for t in (b"zz", b"yy", b"xx", b"ww")] + [(t, 2) for t in (b"a", b"b", b"c")]
    docs_found, scores = segment.search(query, 1, 0)
    assert segment.docs["doc_id"][docs_found].tolist() == [2000] and len(segment.open) < len(segment.blocks) / 8
    opened = len(segment.open)
    assert len(segment.search(query, 1, int(scores[0]) + 1)[0]) == 0 and len(segment.open) == opened


def test_empty_tables_and_counts(spark):
    docs, items = empty(spark), spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert block_max.search(block_max.build(docs), items).count() == 0
    assert block_max.search(block_max.build(documents(spark)), items.limit(0)).count() == 0
    assert block_max.search(block_max.build(documents(spark, ["", None, "--"], [1, 2, 3])), items).count() == 0
    terms = [plain_terms(t) for t in odd_texts()]
    assert block_max.lengths(documents(spark).repartition(4)) == (sum(map(bool, terms)), sum(map(len, terms)))


def test_op12_over_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    same(queries.op12_block_max(spark, SF).collect(), plain_search(docs, items))


# --- filter audit -------------------------------------------------------------------------------------


def plain_fails(text, i, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and least is not None and least < i), strict=True) if x}


def plain_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(p or "", i, plain_fails(t or "", i, least.get(t or ""))) for i, t, p in docs]
    out = []
    for part in {p for p, _, _ in rows}:
        mine, cells, shapley = [(i, f) for p, i, f in rows if p == part], [], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                failing = sum(f in x[1] for x in mine)
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                cells.append(("".join(order), step, f, len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(part, o, s, *x, shapley[f]) for o, s, f, *x in cells]
    return sorted(out)


def audited(spark, docs, labels, **options):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, n int, good int").repartition(3)
    return sorted(map(tuple, filter_audit.audit(d, spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, part int"), **options).collect()))


def test_audit_equals_running_every_order(spark):
    rng = random.Random(1)
    texts = [*odd_texts(), " ".join(f"w{k}" for k in range(300)), " ".join(f"W{k}" for k in range(200)), "w " * 400 + "#", "é" * 60 + "A", "é" * 40 + "A", "a\x0bb\x0cc\x1cd\x85e\u00a0f"]
    docs = [(None if rng.random() < 0.1 else rng.randrange(60), rng.choice(texts), rng.choice(["p", "q", "", None])) for _ in range(150)]
    labels = [(None if rng.random() < 0.1 else rng.randrange(60), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_many_parts_and_of_none(spark):
    docs = [(i, "same text" if i % 3 else f"text {i} $", f"p{i % 11}") for i in range(60)]
    assert audited(spark, docs, [], held=3) == plain_audit(docs, [])
    assert audited(spark, [], [(1, 1, 1)]) == []


def test_first_failure_table():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for pattern in range(32):
        for o, order in enumerate(filter_audit.ORDERS):
            hits = [s for s, f in enumerate(order) if pattern >> "ABCDE".index(f) & 1]
            assert table[pattern, o] == (hits[0] if hits else 5)


def test_op13_over_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    got = queries.op13_filter_audit(spark, SF)
    assert got.columns[:9] == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert np.array_equal(sorted({r["step"] for r in got.collect()}), [1, 2, 3, 4, 5])
