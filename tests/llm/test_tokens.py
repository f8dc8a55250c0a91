"""Word-cached encoding against whole texts; files and packing against the ids themselves."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.llm import packing, token_files
from moraine.llm.tokens import default_tokenizer, word_encoder

HARD = ["it's 'style don't x'll a", "b'. <|endoftext|>foo a<|endoftext|>, x\u2260 \u0130stanbul \u03a3\u0391\u03a3,", "\u00c9a, caf\u00e9. cafe\u0301. \x1c a\x85b 12,3 (a)(b) ... .a. a.b, -x-", None, "", " \n\t ", "\u00abq\u00bb \ufb01 \u01c5 \u212a"]


def ids_of(text):
    e = word_encoder(default_tokenizer())
    return e.library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=4))
def test_words_encode_as_whole_texts(texts):
    ids, counts = word_encoder(default_tokenizer()).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in ids_of(t)] and counts.tolist() == [len(ids_of(t)) for t in texts]


def test_cleared_cache_changes_nothing():
    from moraine.llm.tokens import WordEncoder

    small = WordEncoder(default_tokenizer(), cache_words=5)
    for _ in range(3):
        ids, _ = small.encode(pa.array(HARD, pa.string()))
        assert ids.tolist() == [i for t in HARD for i in ids_of(t)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")  # extra columns that clash


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_token_files_round_trip(spark, tmp_path):
    rows = [(7, "b b b", "x", 1), (None, "null id", "x", 1), (3, None, "x", 1), (3, "again", "x", 1), (9, "word " * 3000, "x", 1), (1, "", "x", 1)]
    files = token_files.write_token_files(docs_of(spark, rows), f"file://{tmp_path}/out", sequence=16, batch_rows=4)
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc, text, *_) in zip(got, order, strict=True):
        ids = [*ids_of(text), 1]
        assert (r.id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), crc(ids))
        start += len(ids)
    for f in files.collect():
        batches = list(token_files.open_sequences(f.path))
        assert all(str(b.schema.field("ids").type).startswith("fixed_size_list") and b.column("ids").type.list_size == 16 for b in batches)
        assert sum(int(np.count_nonzero(b.column("mask").flatten().to_numpy(zero_copy_only=False))) for b in batches) == f.tokens
        mapped = next(token_files.open_sequences(f.path)).column("ids").flatten()
        assert mapped.to_numpy(zero_copy_only=True).dtype == np.uint16


def test_empty_table_gives_no_file(spark):
    files = token_files.write_token_files(docs_of(spark, []))
    assert files.count() == 0 and token_files.read_token_files(files).count() == 0
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_packing_is_whole_and_gapless(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["tok"] * int(n)), "x", 0) for i, n in enumerate(rng.integers(0, 90, 300))] + [(1, None, "x", 0), (1, "tok " * 200, "x", 0), (None, "tok", "x", 0)]
    got = packing.pack(docs_of(spark, rows), capacity=64).collect()
    assert sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for _, t, *_ in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(by) <= 1.03 * -(-total // 64) + 1
    long = sorted((r for r in got if r.id == 1 and r.length + r.start > 64 or r.id == 1 and r.piece > 0), key=lambda r: r.start)
    assert all(r.start == 64 * r.piece for r in long)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40), max_size=12))
def test_plan_against_first_fit(counts):
    plan = packing.plan_bins(counts, 30)
    packed: dict[int, int] = {}
    for number, held in plan:
        assert number > 0 and sum(held) <= 30 and sum(3 * n > 30 for n in held) <= 2
        for n in held:
            packed[n] = packed.get(n, 0) + number
    assert packed == {n: c for n, c in counts.items() if c}
    bins: list[int] = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = next((i for i, left in enumerate(bins) if left >= n), None)
        if fit is None:
            bins.append(30 - n)
        else:
            bins[fit] -= n
    assert sum(number for number, _ in plan) <= 1.1 * len(bins) + 1


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 5000])
def test_special_strings_and_long_words(text):
    ids, _ = word_encoder(default_tokenizer()).encode(pa.array([text], pa.string()))
    assert ids.tolist() == ids_of(text)


def test_any_sequence_is_a_view_of_its_file(spark):
    texts = [("word " * (40 * i + 1)) for i in range(12)]
    files = token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sequence=64, batch_rows=4, parts=1).collect()
    own = token_files.Sequences(files[0].path)
    everything = np.concatenate([own.ids(i)[own.mask(i)] for i in range(len(own))])
    assert len(everything) == files[0].tokens and len(own) == -(-files[0].tokens // 64)
    index = next(iter(token_files.open_sequences(files[0].index_path)))
    for start, n in zip(index.column("start").to_pylist(), index.column("n_tokens").to_pylist(), strict=True):
        assert own.ids((start + n - 1) // 64)[(start + n - 1) % 64] == 1
    view = own.ids(5)
    assert not view.flags.owndata and view.base is not None and own.mask(0).all()
    with pytest.raises(IndexError):
        own.ids(len(own))


def test_packed_sequences_hold_the_ids(spark):
    rng = np.random.default_rng(9)
    words = ["alpha", "beta,", "gamma's", "Δelta", "42"]
    rows = [(i, " ".join(rng.choice(words, int(n))), "x", 0) for i, n in enumerate(rng.integers(0, 120, 80))] + [(500, None, "x", 0), (501, "", "x", 0)]
    docs = docs_of(spark, rows).repartition(7)
    sequences = packing.pack_sequences(docs, capacity=64)
    found = {}
    for r in sequences.collect():
        ids = np.frombuffer(r.ids, np.uint16)
        assert len(ids) == sum(p.length for p in r.pieces) <= 64
        assert [p.offset for p in r.pieces] == np.cumsum([0, *[p.length for p in r.pieces]])[:-1].tolist()
        for p in r.pieces:
            found.setdefault(p.id, []).append((p.piece, p.start, ids[p.offset : p.offset + p.length].tolist()))
    for i, text, *_ in rows:
        parts = sorted(found[i])
        want = [*ids_of(text), 1]
        assert [x for _, _, own in parts for x in own] == want
        assert [(k, s) for k, s, _ in parts] == [(k, 64 * k) for k in range(-(-len(want) // 64))]
    read = {(r.id, r.piece): r.ids_crc32 for r in packing.read_packed(sequences).collect()}
    assert read == {(i, k): crc(own) for i, parts in found.items() for k, _, own in parts}
