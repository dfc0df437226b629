from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomwork.llm.packing import best_fit, local_search, pack_sequences, slots
from loomwork.llm.token_files import TokenFile, elias_fano, to_bytes, token_boundaries, write_token_files
from loomwork.llm.tokens import encoder, vocabulary_path

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ROWS = [(3, "Hello wörld"), (1, None), (2, ""), (5, "x" * 5000 + " y"), (4, "Hello wörld"), (4, "again"), (-7, "neg"), (9, "<|endoftext|> it's\n\n  ok")]


def library(name, texts):
    """Ids by a tokenizer of its own, one text at a time."""
    own = Tokenizer.from_file(vocabulary_path(name))
    return [np.array(own.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_equal_the_library(spark, name):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert encoder(vocabulary_path(name)).encode(texts) == library(name, texts)


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_have_their_ids(name):
    texts = ["a <|endoftext|> b", "a<|startoftext|>b it's", "<|ENDOFTEXT|> x <| y |>", "<|endoftext|>" * 3 + "z", "< |endoftext|>", "plain a < | b"]
    found = encoder(vocabulary_path(name)).encode(texts)
    assert found == library(name, texts)
    assert (49407 if "word" in name else 50256) in np.frombuffer(found[0], "<u4")


def test_ids_are_integers(spark, tmp_path):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError):
        token_boundaries(df, vocabulary_path("word_bpe_49k.json"), path=str(tmp_path / "s"))


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab Z<|>'s\n\t\r9é.\x1c\x85 　日́İ½ªS", max_size=30), max_size=5))
def test_odd_texts_equal_the_library(name, texts):
    assert encoder(vocabulary_path(name)).encode(texts) == library(name, texts)


@given(st.lists(st.integers(0, 900), max_size=700), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_file_round_trip(lengths, gap):
    ids = np.random.default_rng(1).integers(0, 60_000, sum(lengths)).astype("<u4")
    names = np.arange(len(lengths)) * (1 + 10**gap) - 50
    for width in (2, 4):
        f = TokenFile(to_bytes(names, np.array(lengths, np.int64), ids.tobytes(), width))
        ends = np.cumsum(lengths)
        assert f.ends().tolist() == ends.tolist() and f.doc_ids().tolist() == names.tolist() and f.ids().tolist() == ids.tolist()
        assert [f.offset(i) for i in range(0, len(lengths) + 1)] == [0, *ends.tolist()]
        if lengths:
            assert f.document(len(lengths) - 1).tolist() == ids[ends[-1] - lengths[-1] :].tolist()


def test_boundaries_are_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    low, a, b, c = elias_fano(ends, int(ends[-1]))
    assert (len(a) + len(b) + len(c)) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 1


def test_token_boundaries(spark, tmp_path):
    path = vocabulary_path("word_bpe_49k.json")
    df = spark.createDataFrame([(*r, 0) for r in [*ROWS, (None, "no id"), (None, None), (None, "and none")]], "doc_id bigint, text string, start int").repartition(3)
    got = sorted(token_boundaries(df, path, path=str(tmp_path / "t")).collect(), key=lambda r: r.start)
    # those without an id come first, then by id; texts decide among equals
    want = [(None, None), (None, "and none"), (None, "no id"), *sorted(ROWS, key=lambda r: (r[0], r[1] or ""))]
    ids = [x + struct.pack("<I", 2) for x in library("word_bpe_49k.json", [t for _, t in want])]
    assert [r.doc_id for r in got] == [d for d, _ in want] and [r.n_tokens for r in got] == [len(x) // 4 for x in ids]
    assert [r.start for r in got] == np.cumsum([0, *[len(x) // 4 for x in ids]])[:-1].tolist() and [r.ids_crc32 for r in got] == [zlib.crc32(x) for x in ids]
    assert token_boundaries(df.where("false"), path).count() == 0


def test_repeated_writing_replaces(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for _ in range(2):
        write_token_files(df, str(tmp_path / "w"), vocabulary_path("word_bpe_49k.json")).collect()
    names = [p.name for p in (tmp_path / "w").iterdir() if not p.name.startswith(".")]
    assert names and all(n.endswith(".lwtok") for n in names)
    with pytest.raises(ValueError):
        TokenFile(b"x" * 100)


def check_bins(counts, bins, capacity):
    used = Counter()
    for content, many in bins.items():
        assert 0 < sum(content) <= capacity
        for length in content:
            used[length] += many
    assert used == Counter({k: v for k, v in counts.items() if v})


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25))
@settings(max_examples=150, deadline=None)
def test_search_keeps_pieces_and_never_worsens(counts):
    first = best_fit(counts, 64)
    check_bins(counts, first, 64)
    then = local_search(first, 64)
    check_bins(counts, then, 64)
    assert sum(then.values()) <= sum(first.values())


def test_search_finds_exchanges():
    poor = Counter({(6, 3): 1, (5, 2): 1, (4, 4): 1, (5, 1): 1})  # 30 = three full sequences of 10
    assert sum(local_search(poor, 10).values()) == 3
    assert len({s[3] for s in slots(Counter({(3, 3, 2): 2, (4,): 1}))}) == 2


def test_pack(spark):
    path = vocabulary_path("byte_bpe_50k.json")
    df = spark.createDataFrame([*ROWS, (None, "no id"), (11, "word " * 4000)], "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS piece", "2 AS ids")
    got = pack_sequences(df, path, with_ids=True).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault((r.doc_id), []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    whole = library("byte_bpe_50k.json", ["word " * 4000])[0] + struct.pack("<I", 2)
    pieces = sorted(by[11], key=lambda r: r.piece)
    assert b"".join(bytes(r.ids) for r in pieces) == whole and all(r.length == 1024 for r in pieces[1:]) and [r.start for r in pieces][0] == 0
    assert len(by[4]) == 2 and len(by[1]) == 1 and by[1][0].length == 1 and len(by[None]) == 1
    assert len(seq) == -(-sum(r.length for r in got) // 1024)
    assert pack_sequences(df.where("false"), path).count() == 0
