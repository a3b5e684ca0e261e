"""Documents with every odd case: nulls, empty, long, ties, copies, repeats, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, sha int"
VOCAB = ["the", "of", "river", "stone", "and", "walks", "green", "in", "to", "house", "über", "été", "night", "l'eau", "x1", "bird", "sings", "loud", "was", "grey"]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + (rng.choice([".", ",", "\n"]) if rng.random() < 0.15 else "") for _ in range(n))


def odd_texts(seed=0):
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (3, 40, 80, 120, 200)]
    long_ = prose(rng, 9000)
    return [
        None, "", " ", "\n\n", "a", "...", "中文 字符", "tab\tand space   x", "<|endoftext|> in <|startoftext|>text", "\x00\x1c ctrl",
        *base, base[2], base[3] + " end", base[4].replace("river", "rivers", 1), "pre " + base[4], long_, "0" + long_[1:], long_.upper(), "x" * 5000, "ab" * 200, base[1] + "\n" + base[2],
    ]


def documents(spark, texts=None, ids=None):
    texts = odd_texts() if texts is None else texts
    ids = list(range(0, 3 * len(texts), 3)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "u", 1) for i, t in zip(ids, texts, strict=True)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
