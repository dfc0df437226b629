"""Whole-text encoding with a public tokenizer, run once per distinct piece of text.

A tokenizer cuts a text into pre-tokens and encodes each on its own, so a text's ids are those
of its pieces put end to end, for every cutting that only cuts between pre-tokens.  A text that
may hold the string of an added token goes to the library whole (it has ids of its own).  A worker
keeps the ids of the pieces it has met, in a table of bounded size, and asks the library for
the others, many at a time.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Piece tables stop growing here: about 100 MB in each Python worker.
CACHE_ENTRIES = 500_000
CACHED_CHARS = 40
#: Texts are cut in blocks of about so many characters: new pieces are asked for once a block.
BLOCK_CHARS = 2_000_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters alone are cut at every pre-token: both vocabularies' patterns then
#: have a plain reading (letters, digits, others; no apostrophe, so no contractions).
_SIMPLE = re.compile(rf"[\t\n\r\x20-\x26\x28-\x7e{_LETTERS}]*\Z")
_SPACED = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_UNSPACED = re.compile(rf"[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: Other texts are cut only where white space follows something else ...
_CHUNK = re.compile(r"\s*\S+|\s+")
#: ... unless they have characters that Python and the vocabularies may class differently.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the library does with
    ``add_special_tokens=False``."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.entries = entries
        self.known: dict[str, bytes] = {}
        rules = json.loads(self.tokenizer.to_str())
        #: How the strings of added tokens begin.
        self.added = sorted({t["content"][:2] for t in rules["added_tokens"]})
        steps = json.dumps([rules["normalizer"], rules["pre_tokenizer"]])
        if rules["normalizer"] is None and rules["pre_tokenizer"].get("use_regex"):
            self.pieces, self.lower, self.between = _SPACED, False, "\n"
        elif "Lowercase" in steps and '"Split"' in steps:
            self.pieces, self.lower, self.between = _UNSPACED, True, " | "
        else:
            self.pieces, self.lower, self.between = None, False, ""
        self.mark = self.between.strip(" ")
        ids = self.tokenizer.encode(f"a{self.between}a", add_special_tokens=False).ids
        if self.between and len(ids) != 3:
            raise ValueError(f"{path}: {self.mark!r} is not one id")
        self.mark_id = ids[1] if self.between else -1

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, with nothing kept or shared."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _joined(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of visible pieces without the mark: hundreds go to the library as one text, with
        marks between them, and its ids are cut at the mark's."""
        out = {}
        for k in range(0, len(pieces), 400):
            part = pieces[k : k + 400]
            ids = np.asarray(self.tokenizer.encode(self.between.join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(ids == self.mark_id) * 4).tolist()
            if len(ends) != len(part) - 1:
                out.update(zip(part, self.whole(part), strict=True))
                continue
            raw = ids.tobytes()
            out.update(zip(part, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)], strict=True))
        return out

    def _cut(self, text: str) -> list[str] | None:
        """Pieces that the library encodes each on its own; None: encode the text whole."""
        if any(a in text for a in self.added):
            return None
        if self.pieces and _SIMPLE.match(text):
            return self.pieces.findall(text.lower() if self.lower else text)
        return None if _ODD_SPACE.search(text) else _CHUNK.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null is an empty text."""
        out, block, size = [], [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block) if block else out

    def _block(self, texts: list[str]) -> list[bytes]:
        known = self.known
        cut = [self._cut(t) for t in texts]
        wanted = set().union(*[c for c in cut if c]).difference(known)
        mark = self.mark
        fresh = self._joined([c for c in wanted if mark not in c and not c.isspace()]) if mark else {}
        rest = [c for c in wanted if c not in fresh]
        fresh.update(zip(rest, self.whole(rest), strict=True))
        room = self.entries - len(known)
        if room > 0:
            known.update([(k, v) for k, v in fresh.items() if len(k) <= CACHED_CHARS][:room])
        ids = known.get
        new = fresh.get
        whole = iter(self.whole([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(whole) if c is None else b"".join([ids(x) or new(x, b"") for x in c]) for c in cut]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str, entries: int = CACHE_ENTRIES) -> PieceEncoder:
    """One encoder for each vocabulary and worker process, kept between tasks."""
    return PieceEncoder(path, entries)
