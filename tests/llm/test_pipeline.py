from __future__ import annotations

import re
import struct
import zlib

from tests.conftest import DATA
from tests.llm.test_decontaminate import words
from tests.llm.test_duplicates import brute
from tests.llm.test_quality import reference


def test_stages_equal_brute_force(spark):
    """Every stage on what the one before kept, rows held against plain Python."""
    import corpus_pipeline as cp
    from loomwork.llm.pii import redact
    from loomwork.llm.tokens import vocabulary_path
    from tokenizers import Tokenizer

    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "pii_redaction", "best_fit_packing"]
    sf = f"{DATA}/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in source.collect()}

    def good(text):
        n, chars, symbols, again, repeats = reference(text)
        lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        shouts = (text or "").count("!")
        return not (n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or 5 * shouts > n or chars < 2 * n or chars > 15 * n or lines >= 4 and 2 * again > lines)

    items = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := words(r.text)) for k in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in items}

    def leaks(text):
        w = words(text)
        return any(tuple(w[k : k + n]) in items for n in sizes for k in range(len(w) - n + 1))

    first = {d: t for d, t in rows.items() if good(t)}
    one = {d: first[d] for d, _, comp in brute(list(first.items())) if d == comp}
    clean = {d: t for d, t in one.items() if not leaks(t)}
    hidden = {d: redact(t) for d, t in clean.items()}
    assert len(rows) > len(first) > len(one) > len(clean) and hidden != clean

    docs = source
    for (_, stage), want in zip(cp.STAGES[:-1], (first, one, clean, hidden), strict=True):
        docs = stage(spark, docs, sf)
        assert docs.columns == source.columns
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
        docs = spark.createDataFrame(got, docs.schema)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    own = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    pieces, used = {}, {}
    for r in cp.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(hidden)
    for d, text in hidden.items():
        ids = [*own.encode(text, add_special_tokens=False).ids, 2]
        for r in sorted(pieces[d], key=lambda r: r.piece):
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        assert sum(r.length for r in pieces[d]) == len(ids)
    for s in used.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for s in used.values() for _, n in s)
    assert len(used) <= -(-total // 1024) + 2


def test_empty(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, f"{DATA}/sf0.001")
        assert docs.count() == 0
