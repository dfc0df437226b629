from __future__ import annotations

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm.token_counts import TokenCounter, count_tokens
from loomwork.llm.tokens import vocabulary_path
from tests.conftest import DATA

PATH = vocabulary_path("piece_bpe_32k.model")
WHOLE = sentencepiece.SentencePieceProcessor(model_file=PATH)
SMALL = TokenCounter(PATH, part_bytes=8, batch_bytes=40)
CASES = [
    None, "", " ", "   ", "a", "▁", "a ▁ b", "one  two   three ", " lead", "tail ", "<s>hello</s> <unk>", "\n\n\t x", "\x00a\x00", "123 4567", "日本語 テスト", "\U0001f600 \U0001f680\U0001f680",
    "x" * 3000, " " * 3000, "\n" * 500, "The quick brown fox. " * 400, "ăâîșț" * 300, "�" * 50, "é" * 80, "if (x) {\n        return y;\n    }\n" * 50,
]


def whole(text):
    return len(WHOLE.encode(text or ""))


def test_parts_count_as_the_library_counts_whole_texts():
    assert SMALL.cuts
    assert SMALL.count(CASES).tolist() == [whole(t) for t in CASES]
    assert TokenCounter(PATH).count(CASES).tolist() == [whole(t) for t in CASES]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabcethinos019.,<>/_-éßжд中"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_any_text(text):
    assert SMALL.count([text]).tolist() == [whole(text)]


def test_parts_are_bounded():
    text = "some words of a plain text " * 10_000
    parts = list(TokenCounter(PATH)._cut(text))
    assert "".join(parts) == text and max(map(len, parts)) < 16_500


def test_query_columns_and_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate(CASES)] + [(None, "no id", "x"), (3, "again", "y"), (3, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH, limit=100).collect()))
    want = sorted((k is None, k or 0, len((t or "").encode()), whole(t), whole(t) > 100) for k, t, _ in rows)
    assert got == want
    assert count_tokens(df.where("false"), PATH).count() == 0
    assert count_tokens(df, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_whole_table_against_the_library(spark):
    from loomwork.llm import queries

    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in queries.queries()["op13_token_counts"](spark, f"{DATA}/sf0.01").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        n = whole(r.text)
        assert got[r.doc_id] == (n, n > 4096)
