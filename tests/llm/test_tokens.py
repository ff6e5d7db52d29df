"""Token files and packing: exact round trips against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterweave.llm import dac, packing, tokens
from rasterweave.llm.common import scratch

ENCODER = tokens.TextEncoder()
PIECES = [" ", "  ", "\n", "\t", "a", "Bé", "'s", "'", "12", "½", "!", "?!", "_", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "Ⅷ", "²", "\u0301", "😀", "<|endoftext|>", " <", "word", ".", ",", "\r\n", "ǅ", "中文", "%%%"]


def plain(text):
    return np.asarray(ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=30))
def test_pieces_encode_as_the_whole_text(text):
    assert ENCODER.encode(text) == plain(text)


def test_forgetting_changes_nothing():
    small = tokens.TextEncoder(slots=8)
    text = "one two, three. four\nfive six!! one two, three"
    assert small.encode(text) == plain(text) == small.encode(text)
    small = tokens.TextEncoder(slots=64)
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 90))) for _ in range(int(rng.integers(1, 20))))
        assert small.encode(text) == plain(text)


def test_batches_equal_single_texts():
    texts = [None, "", "one", "a<|endoftext|>b", "x\u00a0 y\u00e9 z", " lead", "trail ", "\n", "caf\u00e9, d\u00e9j\u00e0 vu", "w " * 300]
    ids, sizes = ENCODER.encode_all(texts, 7)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].astype("<u4").tobytes() == plain(t) + b"\7\0\0\0"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 257, 65535, 65536, 2**24, 2**32 - 1]) | st.integers(0, 50256), max_size=1200), st.data())
def test_directly_addressable_codes(ids, data):
    f = dac.DacFile(dac.encode_file([3, None], [0, len(ids)], np.array(ids, np.uint32)))
    assert f.tokens(0, len(ids)).tolist() == ids and f.n == len(ids) and f.null.tolist() == [False, True]
    for _ in range(min(20, len(ids))):
        i = data.draw(st.integers(0, len(ids) - 1))
        assert f.token(i) == ids[i]
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert f.tokens(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        f.token(len(ids))


def test_no_token_file():
    with pytest.raises(ValueError):
        dac.DacFile(b"nothing")


ROWS = [(5, "one two three"), (2, None), (9, ""), (None, "lost id"), (2, "again"), (7, "long word " * 3000), (5, "one two three"), (1, "a<|endoftext|>b")]


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, local string").repartition(3)
    folder = scratch(spark, "test-tokens")
    manifest = dac.write_token_files(docs, folder, file_tokens=50)
    got = sorted(map(tuple, dac.read_token_files(spark, folder, manifest).collect()), key=lambda r: r[1])
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in order:
        data = plain(t) + b"\0\0\0\0"
        want.append((i, at, len(data) // 4, zlib.crc32(data)))
        at += len(data) // 4
    assert got == want


def test_rows_of_one_id_are_dealt_to_several_tasks(spark):
    """A third of all rows has no id, another third one id: neither is one task, and the order holds."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{(i * 7919) % 1009} text {i} " + "w " * (i % 50)) for i in range(900)]
    folder = scratch(spark, "hot-ids")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = dac.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert manifest.count() >= 4 and max(r.n_docs for r in manifest.collect()) < 400
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in dac.read_token_files(spark, folder, manifest).orderBy("start").collect()]
    at = 0
    for (doc_id, text), row in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())), got, strict=True):
        ids = plain(text) + b"\0\0\0\0"
        assert row == (doc_id, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_empty_token_files(spark):
    folder = scratch(spark, "test-tokens")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").where("false")
    manifest = dac.write_token_files(docs, folder)
    assert manifest.count() == 0
    back = dac.read_token_files(spark, folder, manifest)
    assert back.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and back.count() == 0


def check_packing(docs, rows, capacity, end_id):
    want = {}
    for k, (i, t) in enumerate(docs):
        want.setdefault(i, []).append(plain(t) + np.asarray([end_id], "<u4").tobytes())
    pieces = {}
    for r in rows:
        assert 0 < r.length <= capacity
        n = {len(d) // 4 for d in want[r.doc_id]}
        assert any(zlib.crc32(d[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for d in want[r.doc_id])
        assert any(r.start == 0 or (r.start - (m % capacity or capacity)) % capacity == 0 for m in n)
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(d) // 4 for v in want.values() for d in v)
    for own in pieces.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(pieces)


def test_packing(spark):
    rng = np.random.default_rng(4)
    docs = ROWS + [(100 + i, "word " * int(rng.integers(0, 90))) for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, length int").repartition(5)
    for capacity in (64, 1024):
        rows = packing.pack(df, capacity).collect()
        used = check_packing(docs, rows, capacity, 2)
        assert used <= 1.05 * sum(r.length for r in rows) / capacity + 2
    assert packing.pack(df.where("false")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=300))
def test_plan_places_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=41)
    runs = packing.plan(counts, 40)
    slots, fill = [], {}
    for n, first, many, sequence, offset in runs:
        slots += [(n, first + k) for k in range(many)]
        for k in range(many):
            fill.setdefault(sequence + k, []).append((offset, n))
    assert sorted(slots) == [(n, k) for n in range(41) for k in range(counts[n])]
    assert all(sum(n for _, n in own) <= 40 for own in fill.values())
    assert all(len({o for o, _ in own}) == len(own) for own in fill.values())


def test_least_squares_fits_an_exact_histogram():
    lengths = np.array([300, 400, 324, 512, 1000, 24])
    p = packing.patterns(lengths, 1024)
    assert {tuple(sorted(r)) for r in p.tolist()} >= {(300, 324, 400), (0, 512, 512), (0, 24, 1000)}
    counts = np.zeros(1025, np.int64)
    counts[[300, 400, 324]] = 700
    counts[512] = 600
    counts[[1000, 24]] = 50
    assert (packing.plan(counts, 1024)[:, 3] + packing.plan(counts, 1024)[:, 2]).max() == 700 + 300 + 50


def piecewise_best_fit(counts, capacity):
    rooms = []
    for n in range(capacity, 0, -1):
        for _ in range(counts[n]):
            k = min((k for k in range(len(rooms)) if rooms[k] >= n), key=lambda k: rooms[k], default=None)
            if k is None:
                rooms.append(capacity - n)
            else:
                rooms[k] -= n
    return len(rooms)


def test_best_fit_fills_open_sequences_with_hot_lengths():
    counts = np.zeros(1025, np.int64)
    counts[600], counts[100] = 1000, 5000
    runs = packing.plan(counts, 1024)
    assert (runs[:, 3] + runs[:, 2]).max() == 1100  # no packing needs fewer than 1075
    rng = np.random.default_rng(6)
    for _ in range(40):
        counts = np.zeros(65, np.int64)
        np.add.at(counts, rng.integers(1, 65, 5), rng.integers(1, 60, 5))
        assert sum(k for _, k in packing._best_fit(counts.copy(), 64)) == piecewise_best_fit(counts, 64)
