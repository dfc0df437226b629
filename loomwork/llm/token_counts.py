"""Token counts of whole texts, as a sentencepiece model gives them, without keeping the ids.

An Arrow function gets the texts and returns lengths alone.  Inside it, texts are cut at safe
boundaries and dealt into batches of about equal bytes, so neither a very long text nor many
long ones in a row make a large batch.

A boundary is safe between two characters that stand side by side in no piece of the vocabulary:
byte-pair merges only ever form pieces, so none reaches across, and the merges on either side do
not know of each other.  What follows a cut goes to a second processor of the same model that puts
no space before a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are cut about here, and batches are closed here (bytes of UTF-8).
PART_BYTES = 32_768
BATCH_BYTES = 524_288
SPACE = "▁"


class TokenCounter:
    """Counts the tokens of texts as ``SentencePieceProcessor.encode`` gives them, without begin or end."""

    def __init__(self, path: str, part_bytes: int = PART_BYTES, batch_bytes: int = BATCH_BYTES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        with open(path, "rb") as f:
            rules = model_pb2.ModelProto.FromString(f.read())
        self.first = sentencepiece.SentencePieceProcessor(model_proto=rules.SerializeToString())
        self.part_bytes, self.batch_bytes = part_bytes, batch_bytes
        norm, kinds = rules.normalizer_spec, rules.trainer_spec
        #: Cutting needs merges of characters as they stand; other models get whole texts.
        self.cuts = (
            kinds.model_type == kinds.BPE and norm.name == "identity" and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
            and norm.escape_whitespaces and not kinds.treat_whitespace_as_suffix and kinds.byte_fallback and all(p.type != p.USER_DEFINED for p in rules.pieces)
        )
        norm.add_dummy_prefix = False
        self.later = sentencepiece.SentencePieceProcessor(model_proto=rules.SerializeToString())
        self.beside = frozenset(a + b for p in rules.pieces if p.type == p.NORMAL for a, b in zip(p.piece, p.piece[1:], strict=False))

    def _cut(self, text: str) -> Iterator[str]:
        """Parts of about ``part_bytes``; a stretch without a safe boundary stays whole."""
        start, width = 0, max(1, self.part_bytes // 2)
        at = width
        while at < len(text):
            if text[at - 1 : at + 1].replace(" ", SPACE) in self.beside:
                at += 1
                continue
            yield text[start:at]
            start, at = at, at + width
        yield text[start:]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text; null is an empty text."""
        total = np.zeros(len(texts), np.int64)
        pending: dict[bool, tuple[list[int], list[str]]] = {True: ([], []), False: ([], [])}
        size = dict.fromkeys(pending, 0)

        def close(leads: bool) -> None:
            rows, parts = pending[leads]
            if parts:
                ids = (self.first if leads else self.later).encode(parts, num_threads=1)
                np.add.at(total, rows, [len(x) for x in ids])
            pending[leads] = ([], [])
            size[leads] = 0

        for row, text in enumerate(texts):
            leads = True
            for part in self._cut(text or "") if self.cuts else [text or ""]:
                pending[leads][0].append(row)
                pending[leads][1].append(part)
                size[leads] += 4 * len(part) if not part.isascii() else len(part)
                if size[leads] >= self.batch_bytes:
                    close(leads)
                leads = False
        close(True)
        close(False)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One for each model and worker process, kept between tasks."""
    return TokenCounter(path)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of ``text`` under the sentencepiece model at ``path``."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(counter(path).count(texts.to_pylist()), pa.int64())

    return lengths(text)


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens, over_limit for each row of ``docs``.

    A null text is empty: no bytes, no tokens.  Every row gives one row: repeated rows and null ids
    too; other columns are not read, whatever their names.  An empty table gives an empty one.
    Texts of any length are counted whole.  One scan, no shuffle.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    counted = docs.select(docs[id_col].alias(id_col), F.octet_length(body).cast("long").alias("n_bytes"), token_count(body, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
