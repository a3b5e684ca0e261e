"""Language by cross-parsing entropy: how few longest matches against a language's suffix automaton a text needs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def letters(text: str) -> str:
    """The words of a text in lower case with a space around each; '' if it has no letter."""
    words = LETTERS.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


def automaton(text: str) -> dict:
    """The root of the suffix automaton of a text (Blumer et al. 1985). A state is the dict of its transitions: character -> state."""
    root: dict = {}
    states, link, length, last = [root], [-1], [0], 0
    at = {id(root): 0}
    for c in text:
        new = len(states)
        states.append({})
        at[id(states[new])] = new
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in states[p]:
            states[p][c] = states[new]
            p = link[p]
        if p >= 0:
            q = at[id(states[p][c])]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(states)
                states.append(dict(states[q]))
                at[id(states[copy])] = copy
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and states[p].get(c) is states[q]:
                    states[p][c] = states[copy]
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return root


def phrases(text: str, root: dict) -> int:
    """Longest matches into which a text is cut from the left; a character never seen is one of its own. An empty text has none."""
    n, state = 0, root
    for c in text:
        nxt = state.get(c)
        if nxt is None:  # the match ends here, and the next begins with this character
            n += state is not root
            nxt = root.get(c)
            if nxt is None:
                n += 1
                nxt = root
        state = nxt
    return n + (state is not root)


class Model:
    """Languages with their labelled text; weight: log2 of its length, as longer texts give longer matches (Ziv and Merhav 1993)."""

    def __init__(self, learned: dict[str, str]):
        self.langs = sorted(learned)
        self.learned = [learned[lang] for lang in self.langs]
        self.weight = [math.log2(len(t) + 1) for t in self.learned]
        self.roots = None

    def __getstate__(self):
        """Automata are built where they are used, for each task."""
        return self.__dict__ | {"roots": None}

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - least cost / next), or (und, 0) for no letter or no language. Ties go to the first name."""
        own = letters(text) if text else ""
        if not own or not self.langs:
            return UNKNOWN, 0.0
        if self.roots is None:
            self.roots = [automaton(t) for t in self.learned]
        cost = sorted((phrases(own, root) * w, lang) for root, w, lang in zip(self.roots, self.weight, self.langs, strict=True))
        return cost[0][1], 1 - cost[0][0] / cost[1][0] if len(cost) > 1 else 1.0


def held_out(doc_id):
    """The fold that is never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, lang_chars: int = 20_000, passage: int = 1000, all_chars: int = 500_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of a bounded sample of the labelled rows outside the held-out fold.

    Of every label, rows chosen by a hash of the id give one passage of at most `passage`
    characters each, at a place that the hash chooses too, until there are lang_chars of them;
    the automaton is of these passages, one behind the other. No label is left out: if there
    are more than all_chars / lang_chars, they share all_chars. About twice the characters wanted reach
    the driver, whatever the size of the table. Rows with a null id, text or label teach nothing.
    """
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"), docs[lang_col].alias("l")).where("i is not null and l is not null and t is not null").where(~held_out(F.col("i")))
    # mean length of a passage by label: how many rows give the characters wanted
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"), F.avg(F.least(F.length("t"), F.lit(passage))).alias("chars")).where("chars > 0").orderBy("l").collect()  # one row for each label
    if not sizes:
        return Model({})
    lang_chars = max(1, min(lang_chars, all_chars // len(sizes)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, (2 * lang_chars / r["chars"] + 8) / r["n"]))])
    u = F.pmod(F.xxhash64(F.col("i"), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = F.pmod(F.xxhash64(F.col("i"), F.lit(8)), F.greatest(F.length("t") - passage, F.lit(0)) + 1).cast("int") + 1
    some = rows.where(u < F.element_at(share, F.col("l"))).select("l", F.substring("t", at, F.lit(passage)).alias("t"), u.alias("u")).orderBy("u", "l", "t").collect()
    out: dict[str, str] = {}
    for r in some:
        if len(out.get(r["l"], "")) < lang_chars and (own := letters(r["t"])):
            out[r["l"]] = (out.get(r["l"], "") + own)[: max(lang_chars, len(own))]
    return Model(out)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1), and the columns in `keep`.

    Only the text is looked at, all of it: its words in lower case are parsed from the first to the last
    character, matches running across words, against the automaton of every language. Text null, empty or
    without letters, or an empty model: ('und', 0). A null id counts as not held out. Repeated
    rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by learn(): all_chars characters, or one for each label

    @F.pandas_udf(PREDICTION)
    def predict(text: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        try:
            for some in text:  # only the text goes to Python, and only the prediction comes back
                yield pd.DataFrame([m.predict(t) for t in some], columns=["lang_pred", "score"])
        finally:
            m.roots = None  # the worker lives on, and keeps the model itself

    predict = predict.asNondeterministic()  # a filter on the prediction must not have it made twice
    doc_id = docs[id_col].cast("long")
    out = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), predict(docs[text_col]).alias("told"), *[docs[c] for c in keep])
    return out.select("doc_id", "held_out", "told.lang_pred", "told.score", *keep)
