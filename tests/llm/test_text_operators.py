import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphduo.llm import html_main, language_id, spot_signatures
from graphduo.llm.spot_signatures import Codes, jaccard, signatures

from .tables import VOCAB, documents, empty, odd_texts, prose


# --- spot signatures ----------------------------------------------------------------------------------


def test_fingerprints_of_texts_edits_and_neighbours(spark):
    texts = odd_texts()
    rows = sorted(zip(range(0, 3 * len(texts), 3), (t or "" for t in texts), strict=True), reverse=True)
    got = {r["doc_id"]: r for r in spot_signatures.fingerprint_pairs(documents(spark).repartition(3)).collect()}
    codes = Codes()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == jaccard(signatures(t, codes), signatures(edited, codes)) and r["near_next"] == jaccard(signatures(t, codes), signatures(nxt, codes))
        assert r["edited_fingerprint"] == spot_signatures.printed(signatures(edited, codes))
    same = [got[i]["fingerprint"] for i, t in rows if t == texts[12]]
    assert len(same) == 2 and len(set(same)) == 1


def plain_signatures(text):
    """(anchor, next two content words) for each anchor and the start of the text, as tuples."""
    words = re.findall(r"\w+", text.lower())
    if not words:
        return {("\0", text)} if text else set()
    out = set()
    for k in [-1, *[k for k, w in enumerate(words) if w in spot_signatures.ANCHORS]]:
        chain = [w for w in words[k + 1 :] if w not in spot_signatures.ANCHORS][:2]
        if chain or k < 0:
            out.add((words[k] if k >= 0 else None, *chain))
    return out


def test_fingerprints_hold_the_plain_sets(spark):
    texts = odd_texts()
    rows = sorted(zip(range(0, 3 * len(texts), 3), (t or "" for t in texts), strict=True), reverse=True)
    got = {r["doc_id"]: r for r in spot_signatures.fingerprint_pairs(documents(spark).repartition(3)).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(a == b)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["near_edited"] == pytest.approx(like(plain_signatures(t), plain_signatures(edited)))
        assert got[i]["near_next"] == pytest.approx(like(plain_signatures(t), plain_signatures(nxt)))
        own, other = spot_signatures.read(got[i]["fingerprint"]), spot_signatures.read(got[i]["edited_fingerprint"])
        assert len(own) == len(plain_signatures(t)) == got[i]["n_signatures"] and jaccard(own, other) == got[i]["near_edited"]


def test_ranges_by_binary_search(spark):
    rows = spark.range(0, 3000).select(F.col("id").alias("key"))
    for splits in ([], [5], [5, 9], [-7, 0, 4, 5, 9, 10, 11, 5000], list(range(0, 2400, 2))):
        got = {r["key"]: r["r"] for r in rows.select("key", spot_signatures.range_of(splits).alias("r")).collect()}
        assert all(got[k] == sum(x <= k for x in splits) for k in (0, 4, 5, 9, 10, 2399, 2999))


def test_fingerprints_of_odd_tables(spark):
    assert spot_signatures.fingerprint_pairs(empty(spark)).count() == 0
    one = spot_signatures.fingerprint_pairs(documents(spark, ["the river walks in green"], [4])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    some = spot_signatures.fingerprint_pairs(documents(spark, ["the a b", "the c d", "the e f", None], [5, 5, None, None])).collect()
    assert sorted(str(r["doc_id"]) for r in some) == ["5", "5", "None", "None"]


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(5)
    base = [prose(rng, 150) for _ in range(12)]
    texts = base + [b.replace("night", "day", 1) for b in base[:6]] + [base[0], base[0], None, ""] + [b + " house" for b in base[6:9]]
    codes = Codes()
    first = {}
    for i, t in enumerate(texts):
        s = tuple(signatures(t or "", codes).tolist())
        if s:
            first.setdefault(s, i)
    want = {(min(a, b), max(a, b)) for sa, a in first.items() for sb, b in first.items() if a != b and jaccard(np.array(sa, "<u8"), np.array(sb, "<u8")) >= 0.8}
    got = {(r["a"], r["b"]) for r in spot_signatures.similar_pairs(documents(spark, texts, list(range(len(texts))))).collect()}
    assert got == want and want


def test_similar_sets_meet_by_length_part(spark):
    plan = spot_signatures.similar_pairs(documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in x and x.count("part#") == 2 for x in plan.splitlines())


# --- language -----------------------------------------------------------------------------------------

WORDS = {"en": ["the", "thing", "that", "when", "weather", "house", "together"], "fr": ["le", "eau", "oiseau", "quelque", "maison", "toujours", "beaucoup"]}


def labelled(spark, n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang, "s", 0, "u", 1))
    return spark.createDataFrame(rows, documents(spark, []).schema)


def longest_matches(text, learned):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in learned:
            k += 1
        n, at = n + 1, at + k
    return n


def test_phrases_are_greedy_longest_matches():
    learned = " the thing that weather "
    root = language_id.automaton(learned)
    for w in ("the", "thin", "wether", "zzz", "thatthing", "x", "e", "", " the thing", "thing that the weather zz z", learned):
        assert language_id.phrases(w, root) == longest_matches(w, learned)


def test_predictions_against_plain_parsing(spark):
    docs = labelled(spark)
    model = language_id.learn(docs, lang_chars=400)
    rows = {r["doc_id"]: r for r in language_id.identify(docs, model, keep=("text",)).collect()}
    for r in rows.values():
        own = " " + " ".join("".join(c if c.isalpha() else " " for c in r["text"].lower()).split()) + " "
        cost = sorted((longest_matches(own, t) * math.log2(len(t) + 1), lang) for lang, t in zip(model.langs, model.learned, strict=True))
        assert r["lang_pred"] == cost[0][1] and r["score"] == pytest.approx(1 - cost[0][0] / cost[1][0])


def test_what_is_learned_are_passages_of_the_other_folds(spark):
    docs = labelled(spark)
    own = {"en": "", "fr": ""}
    for r in docs.where(~language_id.held_out(F.col("doc_id"))).collect():
        own[r["lang"]] += "|" + language_id.letters(r["text"])
    model = language_id.learn(docs, lang_chars=600, passage=50)
    for lang, t in zip(model.langs, model.learned, strict=True):
        words = t.split()
        assert 600 <= len(t) + 60 and len(t) <= 600 and " ".join(words[1:3]) in own[lang]
    shares = language_id.learn(docs, lang_chars=600, all_chars=300)
    assert shares.langs == ["en", "fr"] and all(len(t) <= 300 for t in shares.learned)


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, language_id.learn(docs), keep=("lang",)).where("held_out").collect()
    assert len(rows) > 300 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)


def test_languages_held_out(spark):
    docs = labelled(spark)
    model = language_id.learn(docs)
    rows = language_id.identify(docs, model, keep=("lang",)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and all(r["lang"] == r["lang_pred"] and 0 < r["score"] <= 1 for r in held)


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs = labelled(spark).withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert language_id.learn(docs).langs == ["en", "fr"]


def test_every_label_is_learned(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice(f"{chr(0x4E00 + 9 * k)}{chr(0x4E03 + 9 * k)}{chr(0x4E06 + 9 * k)}") for _ in range(6))
    docs = spark.createDataFrame([(100 * k + i, " ".join(word(k) for _ in range(20)), f"l{k:02}", "s", 0, "u", 1) for k in range(70) for i in range(8)], documents(spark, []).schema)
    model = language_id.learn(docs)
    assert len(model.langs) == 70 and all(r["lang"] == r["lang_pred"] for r in language_id.identify(docs, model, keep=("lang",)).collect())


def test_odd_languages(spark):
    model = language_id.learn(labelled(spark))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(documents(spark), model).collect()}
    for i, t in zip(range(0, 999, 3), odd_texts(), strict=False):
        assert (got[i][0] == "und") == (not language_id.LETTERS.search(t or ""))
    nothing = language_id.learn(labelled(spark).withColumn("lang", F.lit(None).cast("string")))
    assert language_id.identify(labelled(spark, 3), nothing).first()["lang_pred"] == "und"
    assert language_id.identify(empty(spark), model).count() == 0 and language_id.learn(empty(spark)).langs == []
    assert language_id.identify(documents(spark, ["the house", None], [None, None]), model).count() == 2


# --- main text ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">We use</div>
<article><h1>Title &amp; more</h1><p><b>Lead.<br><p>One  two\n three&nbsp;four.</p><p>Short.</p><aside>Side</aside><form><input value="x">Send</form><!-- note -->
<section class="comments"><p>First!</p></section></article><footer>&copy; Site</footer>"""


def test_article_without_chrome():
    assert html_main.main_text(PAGE) == "Title & more Lead. One two three four. Short."


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words only", "plain words only"), ("<script>x", ""),
    ("<article><p>a<b>b</b>c</p><p>d</p></article>", "abc d"), ("<div class='ad'>x<article><p>long enough text</p></article>", "long enough text"),
    ("<main><p>in main</p></main><aside>no</aside>", "in main"), ("<article><header><h1>Head</h1></header><p>body</p></article>", "Head body"),
    ("<article><p>&lt;b&gt; &eacute;&#233; &unknown;</p></article>", "<b> éé &unknown;"),
])
def test_small_pages(html, text):
    assert html_main.main_text(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<article><p>abc <script>var x=1;</script> def</p></article>", "abc def"),
    ("<article><p>abc<style>p{}</style>def <noscript>turn it on</noscript>end</p></article>", "abcdef end"),
    ("<article><p>Real words <span class='ad'>BUY NOW</span> go on.</p></article>", "Real words go on."),
    ("<article><p>Keep this <button>x</p></article>", "Keep this"), ("<article><p>Keep <button>x</p><p>and this</p></article>", "Keep and this"),
    ("<article><p>One.</p><div class='related-work'><p>Two.</p></div><div class='notice-period search-results'>Three.</div></article>", "One. Two. Three."),
    ("<article><p>One.</p><div class='cookie-notice x'>a</div><div class='relatedPosts'>b</div><ul id='comment_list'>c</ul><div role='navigation'>d</div></article>", "One."),
    ("<article><header><h1>Head</h1></header><p>Body</p><div class='article-header'>Kept</div></article>", "Head Body Kept"),
    ("<div class='siteHeader'>Name</div><article><p>Body</p></article>", "Body"),
])
def test_text_within_lines_and_whole_names(html, text):
    assert html_main.main_text(html) == text


def test_the_smoothed_ratio_chooses_the_region(monkeypatch):
    links = "".join(f"<div><a href='/{k}'>l{k}</a></div>" for k in range(12))
    page = f"<body>{links}<h1>Head</h1>{''.join(f'<p>{chr(97 + k) * 5} {chr(98 + k) * 180}</p>' for k in range(6))}{links}</body>"
    got = html_main.main_text(page)
    assert got.startswith("Head aaaaa") and "l3" not in got
    monkeypatch.setattr(html_main, "smoothed", lambda ratio, sigma: np.ones(len(ratio)))
    assert "l3" in html_main.main_text(page)


def test_recall_on_pages_without_containers(spark):
    """The tables' pages with their article as a plain div and their menus and adverts without names: what of the text is found, and what else."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    kept = put = right = 0
    for r in rows:
        want = html_main.main_text(r["html"]).split()
        plain = r["html"].replace("<article>", "<div>").replace("</article>", "</div>").replace("<nav>", "<div>").replace("</nav>", "</div>")
        got = html_main.main_text(plain).split()
        both = sum((collections.Counter(want) & collections.Counter(got)).values())
        kept, put, right = kept + len(want), put + len(got), right + both
    assert right >= 0.97 * kept and right >= 0.97 * put, (right / kept, right / put)


def test_density_where_there_is_no_container():
    body = "".join(f"<p>{'word ' * 40}{k}.</p>" for k in range(6))
    links = "".join(f"<div><a href='/{k}'>l{k}</a></div>" for k in range(12))
    got = html_main.main_text(f"<body>{links}<h1>Head</h1>{body}{links}</body>")
    assert got.count("word") == 240 and "l5" not in got and got.startswith("Head ")


def test_whole_texts_where_there_is_no_container():
    links = "".join(f"<div><a href='/{k}'>l{k}</a></div>" for k in range(12))
    long_ = [("x" * 19 + " ") * 10 + str(k) for k in range(6)]
    short = ["Closing words that end it, number %d." % k for k in range(4)]
    p = lambda ts: "".join(f"<p>{t}</p>" for t in ts)
    want = " ".join(["Head", *long_, *short])
    assert html_main.main_text(f"<body>{links}<h1>Head</h1>{p(long_)}{links}</body>") == " ".join(["Head", *long_])
    assert html_main.main_text(f"<body>{links}<h1>Head</h1>{p(long_)}{p(short)}{links}</body>") == want
    assert html_main.main_text(f"<body>{links}<div><h1>Head</h1></div><div>{p(long_)}{p(short)}</div>{links}</body>") == want
    assert html_main.main_text(f"<body>{links}<div><h1>Head</h1>{p(long_)}<h2>End</h2>{p(short)}<h2>More</h2>{links}</div></body>") == " ".join(["Head", *long_, "End", *short])
    assert html_main.main_text(f"<body>{links}<h1>Head</h1>{'<p>'.join(['', *long_, *short])}{links}</body>") == want
    linked = "".join(f"<p><a href='/{k}'>l{k}</a></p>" for k in range(12))
    assert html_main.main_text(f"<body>{linked}<h1>Head</h1>{p(long_)}{p(short)}{linked}</body>") == want
    assert html_main.main_text(f"<body>{links}<h1>Head</h1><p class='ad'>Buy</p>{p(long_)}<p>By <b>one</b> hand.</p>{links}</body>") == " ".join(["Head", *long_, "By one hand."])


def test_comments_and_adverts_beside_and_inside_the_article():
    long_ = " ".join(["word"] * 60)
    said = "".join(f"<article class='{c}'><p>{chr(97 + k) * 4} {long_}</p></article>" for k, c in enumerate(["comment", "comment-body depth-1", "reply", "CommentItem", "disqus-post"]))
    inside = f"<ol class='commentlist'><li>said {long_}</li></ol><div class='adsbygoogle'>buy {long_}</div><div class='google-ads'>buy {long_}</div><div id='taboola-bottom'>more {long_}</div>"
    assert html_main.main_text(f"<body><article class='post sidebar-right'><h1>Head</h1><p>{long_}</p>{inside}</article>{said}</body>") == f"Head {long_}"
    assert html_main.main_text(f"<body>{said}<article class='post comments-open has-comments'><p>one {long_}</p></article></body>") == f"one {long_}"
    assert html_main.main_text(f"<body><main class='comment'><p>{long_}</p></main></body>") == long_  # a page about one comment
    assert html_main.main_text(f"<body><article class='comment'><p>{long_}</p></body>") == ""
    two = f"<article class='part'><p>one {long_}</p></article><article class='part'><p>two {long_}</p></article>"
    assert html_main.main_text(f"<body>{two}{said}</body>") == f"one {long_} two {long_}"


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (None, None, None, 3), (2, "v", "<article>" + "<p>x y</p>" * 20000, 3), (2, "v", "", 3)], "page_id long, url string, html string, text int")
    got = sorted(html_main.extract(pages).collect(), key=str)
    assert len(got) == 4 and all(len(r["text"]) == r["n_chars"] for r in got)
    assert max(r["n_chars"] for r in got) == 20000 * 4 - 1
    assert html_main.extract(pages.limit(0)).count() == 0


def test_vocabulary_is_mixed():
    assert any(w in spot_signatures.ANCHORS for w in VOCAB) and any(w not in spot_signatures.ANCHORS for w in VOCAB)
