"""Pieces of texts by the `tokenizers` library, asked once for each distinct pre-token of a group of texts.

A group of texts is cut, factorised and summed as Arrow and NumPy columns:

1. texts are cut where a pre-token surely ends: before a space or line feed that follows a letter,
   digit or plain sign, between a letter and a sign behind it, and behind a lone line feed. Neither
   tokenizer's pattern reaches across such a place (a token may start with one space, none goes on
   after a letter with a sign or a space), and neither normaliser looks across it;
2. the parts are dictionary-encoded: a table of distinct pre-tokens and an index per occurrence;
3. the library encodes each distinct pre-token once. Plain words go in long strings, in which the
   ids themselves tell where a word starts or ends; all others by themselves;
4. occurrences take their pieces by index, so a document costs a gather and a sum.

Nothing is kept from one group to the next: memory is that of a group, whatever the vocabulary. A
text with the cut mark in it (a null character) goes to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Signs that stand in no contraction and no special string.
SIGN = r'.,!?:;%$#*&()"/=+@\-'
MARK = "\x00"
#: Places of a cut (fixed patterns of the method): the text before and after it.
CUTS = ((rf"([{LETTER}0-9{SIGN}])([ \n])", rf"\1{MARK}\2"), (rf"([{LETTER}])([{SIGN}])", rf"\1{MARK}\2"), (rf"({MARK}\n)([{LETTER}])", rf"\1{MARK}\2"))
#: Bytes of text in a group, words to a call.
GROUP, CALL = 16_000_000, 4096


def load(path: str):
    """The library's tokenizer of a file; one thread, as the executors already use every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[k], start[k] + 1, ... (size[k] of them) for each k in turn."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pieces:
    """A tokenizer's pieces for groups of texts. bounds: for each id, if a word's first (spaced) or last piece has it."""

    def __init__(self, path: str):
        self.tok = load(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix")
        self.spaced = not end  # words carry the space before them; else their last piece is marked, and white space is dropped
        self.lowers = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("AÉ") == "aé"
        self.bounds = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        for piece, i in model["vocab"].items():
            self.bounds[i] = piece.startswith("Ġ") if self.spaced else piece.endswith(end)
        self.line_feed = self.tok.encode("\n", add_special_tokens=False).ids[0] if self.spaced else None
        self.words = [rf"^ [{LETTER}]+$", rf"^[{LETTER}]+$"] if self.spaced else [rf"^[{LETTER}]+$"]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each) of plain words, all with the space before them or all without."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        bare = self.spaced and len(words) > 0 and not words[0].as_py().startswith(" ")  # one word to a line, then
        for lo in range(0, len(words), CALL):
            some = words.slice(lo, CALL).to_pylist()
            text = "\n" + "\n".join(some) if bare else ("" if self.spaced else " ").join(some)
            got = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(got == self.line_feed if bare else self.bounds[got])
            if len(at) != len(some):
                raise ValueError("a word was not encoded as one pre-token")
            ids.append(np.delete(got, at) if bare else got)
            sizes.append(np.diff(np.append(at, len(got))) - bare if self.spaced else np.diff(np.append(-1, at)))
        return np.concatenate(ids), np.concatenate(sizes)

    def of_others(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, "<u4")], [0] * len(parts)
        for lo in range(0, len(parts), CALL):
            for k, e in enumerate(self.tok.encode_batch_fast(parts[lo : lo + CALL], add_special_tokens=False), lo):
                got = np.array(e.ids, "<u4")
                sizes[k] = len(got)
                ids.append(got)
        return np.concatenate(ids), np.array(sizes, np.int64)

    def distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): the pieces of each distinct part."""
        again = None
        if not self.spaced:  # white space is dropped, so parts that differ in it alone are one
            parts = pc.utf8_trim(parts, " \n")
            if self.lowers:
                parts = pc.if_else(pc.match_substring_regex(parts, self.words[0]), pc.utf8_lower(parts), parts)
            coded = parts.dictionary_encode()
            again, parts = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        start, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        ids, held, rest = [], 0, np.ones(len(parts), bool)
        for pattern in [*self.words, None]:
            own = rest if pattern is None else pc.match_substring_regex(parts, pattern).to_numpy(zero_copy_only=False).astype(bool)
            some = parts.filter(pa.array(own))
            got, n = self.of_others(some.to_pylist()) if pattern is None else self.of_words(some)
            start[own], size[own] = held + np.cumsum(n) - n, n
            ids.append(got)
            held, rest = held + len(got), rest & ~own
        ids = np.concatenate(ids)
        return (ids, start, size) if again is None else (ids, start[again], size[again])

    def cut_up(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(the texts' parts in order, coded; where each text's parts start and end). No text has the cut mark in it."""
        for pattern, to in CUTS:
            texts = pc.replace_substring_regex(texts, pattern, to)
        split = pc.split_pattern(texts, MARK)
        return split.flatten().dictionary_encode(), split.offsets.to_numpy()

    def frequencies(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct parts, at, times, ends): text k has the parts at[ends[k - 1] : ends[k]], each so many times. A text with the cut mark in it is one part."""
        marked = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False).astype(bool)
        coded, offsets = self.cut_up(pc.if_else(pa.array(marked), "", texts))
        offsets = offsets.astype(np.int64) - offsets[0]
        parts, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if marked.any():
            whole = texts.filter(pa.array(marked)).dictionary_encode()
            at[offsets[:-1][marked]] = len(parts) + whole.indices.to_numpy(zero_copy_only=False)
            parts = pa.concat_arrays([parts, whole.dictionary])
        key, times = np.unique(np.repeat(np.arange(len(texts)), np.diff(offsets)) * max(len(parts), 1) + at, return_counts=True)
        text, at = np.divmod(key, max(len(parts), 1))
        return parts, at, times, np.searchsorted(text, np.arange(len(texts)), side="right")

    def sizes(self, parts: pa.Array) -> np.ndarray:
        """How many pieces each distinct part has."""
        out = np.zeros(len(parts), np.int64)
        marked = pc.match_substring(parts, MARK).to_numpy(zero_copy_only=False).astype(bool)
        for own, ask in ((~marked, lambda some: self.distinct(some)[2]), (marked, lambda some: self.of_others(some.to_pylist())[1])):
            if own.any():
                out[own] = ask(parts.filter(pa.array(own)))
        return out

    def encode(self, texts: pa.Array, counts_only: bool = False) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has, pre-token occurrences of each). With counts_only no text's ids are formed."""
        if len(texts) == 0:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        marked = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False).astype(bool)
        if marked.any():
            return self._with_whole(texts, marked, counts_only)
        coded, offsets = self.cut_up(texts)
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids, start, size = self.distinct(coded.dictionary)
        each = size[at]
        total = np.append(0, np.cumsum(each))
        lens = total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]]
        return None if counts_only else ids[ragged(start[at], each)], lens, np.diff(offsets).astype(np.int64)

    def _with_whole(self, texts: pa.Array, marked: np.ndarray, counts_only: bool):
        some, some_lens, some_parts = self.encode(texts.filter(pa.array(~marked)), counts_only)
        whole, whole_lens = self.of_others(texts.filter(pa.array(marked)).to_pylist())
        lens, parts = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
        lens[~marked], lens[marked], parts[~marked] = some_lens, whole_lens, some_parts
        if counts_only:
            return None, lens, parts
        start = np.zeros(len(texts), np.int64)
        start[~marked], start[marked] = np.cumsum(some_lens) - some_lens, len(some) + np.cumsum(whole_lens) - whole_lens
        return np.concatenate([some, whole])[ragged(start, lens)], lens, parts


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """This worker's tokenizer of a file: of fixed size, so it is kept for later tasks."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def runs(n_bytes: np.ndarray, most: int = GROUP) -> list[tuple[int, int]]:
    """Successive rows lo .. hi - 1 of about `most` bytes (one row, if that is longer)."""
    out, lo, held = [], 0, 0
    for k, n in enumerate(n_bytes.tolist()):
        held += n
        if held >= most:
            out.append((lo, k + 1))
            lo, held = k + 1, 0
    return [*out, (lo, len(n_bytes))] if lo < len(n_bytes) else out
