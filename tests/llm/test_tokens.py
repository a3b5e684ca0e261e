import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphduo.llm import bit_packing, piece_counts, pieces
from graphduo.llm.queries import vocabulary

from .tables import documents, empty, odd_texts

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 64), st.integers(0, 300), st.integers(0, 300))
def test_images_round_trip(width, ids, block, lo, hi):
    a = np.array(ids, "<u4") & np.uint32((1 << width) - 1)
    image = bit_packing.encode_image(a, width, block)
    assert np.array_equal(bit_packing.decode_image(image), a)
    assert np.array_equal(bit_packing.decode_image(image, min(lo, hi), max(lo, hi)), a[min(lo, hi) : max(lo, hi)])


def test_wrong_images():
    with pytest.raises(ValueError):
        bit_packing.encode_image(np.array([8], "<u4"), 3)
    with pytest.raises(ValueError):
        bit_packing.decode_image(b"x" * 64)
    assert [bit_packing.width_of(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_parts_give_what_the_library_gives(path, spaced):
    rng = random.Random(3)
    alpha = ["a", "B", "é", "ß", "Σ", "İ", "'s", "'", "1", " ", "  ", "\n", "\t", "\x1c", "\x85", ".", "<|endoftext|>", "|>", "中", "é", "🙂", "#", " the", "The,"]
    texts = [t or "" for t in odd_texts()] + ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    tok, mine = pieces.load(path), pieces.Pieces(path)
    assert mine.spaced == spaced
    for k in range(0, len(texts), 100):
        group = pa.array(texts[k : k + 100])
        ids, n, _ = mine.encode(group)
        want = [e.ids for e in tok.encode_batch(group.to_pylist(), add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] == mine.encode(group, counts_only=True)[1].tolist()
        assert ids.tolist() == [i for w in want for i in w]


def test_distinct_pre_tokens_are_encoded_once(monkeypatch):
    mine, asked = pieces.Pieces(BYTE), []
    monkeypatch.setattr(mine, "of_words", lambda words: asked.extend(words.to_pylist()) or (np.zeros(len(words), "<u4"), np.ones(len(words), np.int64)))
    monkeypatch.setattr(mine, "of_others", lambda parts: asked.extend(parts) or (np.zeros(len(parts), "<u4"), np.ones(len(parts), np.int64)))
    mine.encode(pa.array(["the river and the river, and the river", "the river 12 and", ""]))
    assert len(asked) == len(set(asked)) and " river" in asked and "," in asked


def test_documents_of_an_image():
    image = bit_packing.encode_image(np.arange(9, dtype="<u4"), 4, 4, [7, None, -3], [2, 3, 4], 11)
    first, ids, ends = bit_packing.documents_of(image)
    assert (first, ids, ends.tolist()) == (11, [7, None, -3], [2, 5, 9])


def test_counts(spark):
    docs = documents(spark)
    tok = pieces.load(BYTE)
    got = {r["doc_id"]: r for r in piece_counts.count_tokens(docs, BYTE).collect()}
    for i, t in zip(range(0, 999, 3), odd_texts(), strict=False):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert piece_counts.count_tokens(empty(spark), BYTE).count() == 0
    twice = piece_counts.count_tokens(documents(spark, ["a b", "a b", "c"], [1, 1, None]), BYTE).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in twice) == [("1", 2), ("1", 2), ("None", 1)]


def test_counts_meet_over_groups(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "river", "Été", "x9", "don't", "a\x00b", "end."]) for _ in range(rng.randint(0, 900))) for _ in range(60)] + [None, "", "\x00", "the " * 9000]
    docs = documents(spark, texts).repartition(5)
    tok = pieces.load(BYTE)
    got = piece_counts.count_tokens(docs, BYTE, limit=100, group_bytes=3000)
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [(r["n_tokens"], r["over_limit"]) for r in got.orderBy("doc_id").collect()] == [(n, n > 100) for n in want]
    held, parts = piece_counts.frequencies(docs, BYTE, 3000), piece_counts.distinct_parts(docs, BYTE, 3000)
    groups = {r["group"] for r in held.collect()}
    assert len(groups) > 20 and groups == {r["of"] for r in parts.collect()}
    times = sum(int(piece_counts.of_planes(r["times"]).sum()) for r in held.where("n_bytes > 0").collect())
    assert times == got.agg({"n_parts": "sum"}).first()[0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(part" in plan and "CartesianProduct" not in plan


def test_a_pre_token_is_encoded_once_for_all_groups(spark):
    rows = [(g, k, p) for g in range(9) for k, p in enumerate([" river", "the", "12", "b\x00a", "", " Été"])]
    parts = spark.createDataFrame(rows, "of long, number int, part string").repartition(3)
    tok = pieces.load(BYTE)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # runs of one pre-token go over batches
    try:
        got = {(r["of"], r["number"]): r["n_pieces"] for r in piece_counts.counted(parts, BYTE).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(g, k): len(tok.encode(p, add_special_tokens=False).ids) for g, k, p in rows}


def test_planes_round_trip():
    for values in ([], [0], [1, 255, 256, 70_000, 2**32 - 1]):
        assert piece_counts.of_planes(piece_counts.planes(np.array(values, np.int64))).tolist() == values


def test_frequencies_tell_documents_apart():
    mine = pieces.Pieces(BYTE)
    parts, at, times, ends = mine.frequencies(pa.array(["a b a", "", "b\x00a", "b a", ""]))
    names, got, lo = parts.to_pylist(), [], 0
    for hi in ends.tolist():
        got.append({names[k]: int(n) for k, n in zip(at[lo:hi], times[lo:hi], strict=True)})
        lo = hi
    assert got == [{"a": 1, " b": 1, " a": 1}, {"": 1}, {"b\x00a": 1}, {"b": 1, " a": 1}, {"": 1}]
    assert mine.frequencies(pa.array([], pa.string()))[3].tolist() == []


def test_chunks_end_with_the_document_that_fills_them():
    for lens, held in (([4, 4, 4, 30, 1], 0), ([10], 0), ([2, 3], 5), ([3], 0), ([], 4), ([5, 5, 5, 5], 0)):
        want, n = [], held
        for k, x in enumerate(lens):
            n += x
            if n >= 10:
                want.append(k + 1)
                n = 0
        assert bit_packing.chunks(np.cumsum(lens, dtype=np.int64), held, 10) == want


@pytest.mark.parametrize("chunk", [1, 40, 1 << 18])
def test_packed_corpus(spark, chunk):
    texts = odd_texts()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    docs = documents(spark, texts, ids).repartition(5)
    tok, at, want, all_ids = pieces.load(WORD), 0, {}, []
    for i, t in sorted(zip(ids, texts, strict=True)):
        e = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
        all_ids += e
        at += len(e)
    path = bit_packing.write_packed(docs, WORD, chunk_ids=chunk)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in bit_packing.read_documents(spark, path).collect()}
    assert got == want
    for lo, hi in ((0, 5), (7, 4000), (at - 3, at + 9), (0, at), (5, 5)):
        assert list(bit_packing.read_ids(spark, path, lo, hi)) == all_ids[lo:hi]


def test_packed_odd_tables(spark):
    assert bit_packing.pack_corpus(empty(spark), WORD).count() == 0
    rows = bit_packing.pack_corpus(documents(spark, ["b", "a", "c"], [1, 1, None]), WORD).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in rows) == [("1", 2, 2), ("1", 4, 2), ("None", 0, 2)]
