"""Pieces, packing, token files and BPE against the libraries and plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm import bitplanes, bpe, packing, token_counts, tokens
from stowage.llm.tokens import default_path, encoder

ODD = ["", None, " a", "a ", "a  b", "x\n\ny \n z", "İstanbul ǅ \x1c q", "é é ñ", "it's we'll ''s 12345", "　a b", "ΑΣ ΣΑΣ.", "<|endoftext|> a<|endoftext|>", "a" * 3000, "日本語 テキスト", "é ̈x", "﷐ \x00"]
RANKS, BYTE, WORD = (default_path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


def documents(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS piece", "1 AS bucket", "2 AS n_tokens")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_odd_texts(path):
    e = encoder(path)
    ids, starts = e.encode(ODD)
    want = e.tokenizer.encode_batch([t or "" for t in ODD], add_special_tokens=False)
    assert [ids[s:t].tolist() for s, t in zip(starts, starts[1:], strict=False)] == [w.ids for w in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sab1.é"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_any_text(texts):
    for path in (BYTE, WORD):
        e = encoder(path)
        ids, starts = e.encode(texts)
        want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [ids[s:t].tolist() for s, t in zip(starts, starts[1:], strict=False)] == [w.ids for w in want]


def test_planes():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        ids = r.integers(0, 60000, n).astype(np.uint32)
        for bits in (1, 8):
            segment = bitplanes.write_segment([1, None], np.array([n, 0]), ids, block_ids=64, plane_bits=bits)
            ((docs, sizes, back),) = bitplanes.read_segments(segment)
            assert docs == [1, None] and sizes.tolist() == [n, 0] and back.tolist() == ids.tolist()


def expected_ids(texts):
    t = encoder(BYTE).tokenizer
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_bit_plane_files(spark):
    ids = [[*x, 0] for x in expected_ids(ODD)]
    got = sorted(tuple(r) for r in bitplanes.round_trip(documents(spark, ODD).repartition(3), BYTE).collect())
    starts = np.cumsum([0, *map(len, ids)])
    assert got == [(i, int(starts[i]), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]


def test_bit_plane_files_of_several_segments_and_files(spark):
    texts = [f"{t} {i}" for i, t in enumerate([*ODD, "long text " * 3000] * 4)]
    ids = [[*x, 0] for x in expected_ids(texts)]
    starts = np.cumsum([0, *map(len, ids)])
    for bits in (8, 1):
        got = sorted(tuple(r) for r in bitplanes.round_trip(documents(spark, texts).repartition(2), BYTE, plane_bits=bits, block_ids=100, segment_ids=200, segments_per_file=2).collect())
        assert got == [(i, int(starts[i]), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]


def test_the_text_writer_keeps_bytes(spark, tmp_path):
    """The token files rely on it: bytes of a string that are no UTF-8 are written as they are."""
    raw = bytes(range(256)) * 3
    spark.createDataFrame([(bytearray(raw),)], "b binary").selectExpr("cast(b AS string) AS value").coalesce(1).write.option("compression", "none").text(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("part-*")
    assert file.read_bytes() == raw + b"\n"


def test_bit_plane_files_of_nothing_and_of_repeats(spark):
    assert bitplanes.round_trip(documents(spark, []), BYTE).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    assert sorted((r[0] is None, r[1], r[2]) for r in bitplanes.round_trip(same, BYTE).collect()) == [(False, 6, 1), (True, 0, 3), (True, 3, 3)]


def test_separator_scan(spark, tmp_path):
    docs = documents(spark, ODD)
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_token_counts(spark.read.parquet(str(tmp_path / "d")), BYTE).collect()}
    assert got == {i: len(x) for i, x in enumerate(expected_ids(ODD))}


def test_separator_scan_of_several_files(spark, tmp_path):
    texts = [*ODD, "long text " * 3000, *ODD, None, ""]
    documents(spark, texts).repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for rows_per_file in (1, 3):
        got = token_counts.document_token_counts(docs, BYTE, row_bytes=100, rows_per_file=rows_per_file).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(x) for i, x in enumerate(expected_ids(texts))}
        by_place = sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in got)
        at = 0
        for i, (ordinal, start, n) in enumerate(by_place):
            assert (ordinal, start) == (i, at)
            at += n + 1


def test_separator_scan_across_blocks(spark, tmp_path):
    r = random.Random(3)
    lengths = [r.randrange(0, 40) for _ in range(60)]
    stream = np.concatenate([np.append(np.full(n, 5), token_counts.END_ID) for n in [*lengths, 9]])[:-1].astype("<u2")
    (tmp_path / "part-00000").write_bytes(stream[: sum(lengths[:30]) + 30].tobytes())
    (tmp_path / "part-00001").write_bytes(stream[sum(lengths[:30]) + 30 :].tobytes())
    got = sorted((x["ordinal"], x["n_tokens"], x["start"]) for x in token_counts.count_tokens(spark, str(tmp_path), block_ids=16).collect())
    every = [*lengths, 9]
    assert got == [(i, n, sum(every[:i]) + i) for i, n in enumerate(every)]


@pytest.mark.parametrize("layout", [{}, {"buckets": 7, "chunk_bytes": 400}])
def test_bpe(spark, tmp_path, layout):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, *ODD, "the cat the cat " * 500]
    docs = documents(spark, texts)
    docs.repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r[0]: tuple(r)[1:] for r in bpe.digest_documents(docs, RANKS, public_tokenizers.PATTERN, **layout).collect()}
    ids = [library.encode_ordinary(t or "") for t in texts]
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, (x, t) in enumerate(zip(ids, texts, strict=True))}
    whole = {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, **layout).collect()}
    assert whole == {i: (x, (t or "").encode()) for i, (x, t) in enumerate(zip(ids, texts, strict=True))}
    assert bpe.digest_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_buckets_rise_with_the_corpus():
    sizes = [0, 1, 1 << 30, bpe.MANY_BUCKETS * bpe.BUCKET_BYTES, 1 << 40, 1 << 47]
    found = [bpe.buckets_for(n) for n in sizes]
    assert found == sorted(found) and found[0] == 1 and found[3] == bpe.MANY_BUCKETS < found[4]


def test_a_full_table_of_pieces(monkeypatch):
    """Encodes the same whether pieces are kept or not."""
    monkeypatch.setattr(tokens, "KEPT_PIECES", 40)
    monkeypatch.setattr(tokens, "KEPT_PARTS", 30)
    r = random.Random(4)
    for path in (BYTE, WORD):
        e = tokens.PieceEncoder(path)
        for _ in range(30):
            texts = [" ".join(r.choice(["the", "word", "é", "of", "\n", "x1", "y" * 300]) + r.choice(["", "s", str(r.randrange(60))]) for _ in range(12)) for _ in range(3)]
            ids, starts = e.encode(texts)
            want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
            assert [ids[s:t].tolist() for s, t in zip(starts, starts[1:], strict=False)] == [w.ids for w in want]
        assert e.store.count < 120


def test_table_of_hashes():
    r = np.random.default_rng(3)
    table, known = tokens.Table(), {}
    for _ in range(60):
        new = r.integers(0, 1 << 62, (2, 700), np.uint64)
        new[0, :300] = new[0, :300] % 50  # equal first hashes, and places that collide
        new = np.unique(new, axis=1)
        new = new[:, [tuple(k) not in known for k in new.T.tolist()]]
        assert (table.find(new) == -1).all()
        numbers = np.arange(len(known), len(known) + new.shape[1], dtype=np.int32)
        known |= {tuple(k): n for k, n in zip(new.T.tolist(), numbers.tolist(), strict=True)}
        table.add(new, numbers)
    every = np.array(list(known), np.uint64).T
    assert table.find(every).tolist() == list(known.values())


def test_long_texts_and_blocks(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    monkeypatch.setattr(tokens, "LONGEST", 20)
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "bc", " ", " ", "\n", "é", "日本", "'s", "12", "  ", "\u00a0", "\u3000"]) for _ in range(r.randrange(400))) for _ in range(60)]
    for path in (BYTE, WORD):
        e = tokens.PieceEncoder(path)
        ids, starts = e.encode(texts)
        want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [ids[s:t].tolist() for s, t in zip(starts, starts[1:], strict=False)] == [w.ids for w in want]


def test_bpe_with_another_pattern(spark, tmp_path):
    """One by which marks go with the word behind them."""
    pattern = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+"
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("u", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "(word)\n\nnext (word) 12345 a-b " * 30]
    documents(spark, texts).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(spark.read.parquet(str(tmp_path / "d")), RANKS, pattern).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)} and public_tokenizers.PATTERN == bpe.USUAL_PATTERN


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    texts = [*ODD, *ODD, "word " * 5000, None]
    rows = packing.pack_documents(documents(spark, texts), WORD).collect()
    check_packed(rows, 2048)
    t = encoder(WORD).tokenizer
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in own] == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
    assert packing.pack_documents(documents(spark, []), WORD).count() == 0


def test_packing_items_with_columns_of_any_name(spark):
    items = spark.createDataFrame([(i, 0, 1 + i % 7, "x", i, "y") for i in range(40)], "doc_id long, piece int, length long, number string, cell long, place string").withColumnRenamed("place", "base")
    rows = packing.pack(items, 10).collect()
    assert {r["number"] for r in rows} == {"x"} and {r["base"] for r in rows} == {"y"} and [r["cell"] for r in sorted(rows, key=lambda r: r["doc_id"])] == list(range(40))
    check_packed(rows, 10)


def plain_plan(lengths, capacity):
    """The same rules one item at a time."""
    bins, left = [], sorted(n for n in lengths if 3 * n > capacity)
    while left:
        n = left.pop()
        fit = [i for i, m in enumerate(left) if m + n <= capacity]
        bins.append([n, left.pop(fit[-1])] if fit else [n])
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        room = [b for b in bins if sum(b) + n <= capacity]
        if room:
            max(room, key=sum).append(n)
        else:
            bins.append([n])
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_against_one_item_at_a_time(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_bins(counts, 30)
    found = sorted(n for group, bins in plan for n in group * bins)
    assert found == sorted(lengths) and all(sum(g) <= 30 and sum(3 * n > 30 for n in g) <= 2 for g, _ in plan)
    assert sum(bins for _, bins in plan) == len(plain_plan(lengths, 30))
