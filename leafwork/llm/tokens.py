"""Token ids by the files of public tokenizers, remembered per piece of text.

A text of plain characters is cut at the places where the tokenizer itself cuts, and each
piece is encoded once per worker; any other text, and one that may hold the string of an
added token, goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed: letters for which the cuts and byte marks below are those of the tokenizers.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_CUT = rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
WORD_CUT = rf"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+"
PLAIN = rf"[\t-\r -~{LETTERS}]*"


def byte_marks() -> dict[int, str]:
    """Characters that stand for the bytes of plain characters in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    marks = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    plain = [*range(9, 14), *range(32, 127), *range(0xC0, 0x100)]
    return {c: "".join(marks[b] for b in chr(c).encode()) for c in plain}


class Encoder:
    """Ids of a text as the library gives them for ``add_special_tokens=False``: nothing is
    put around the text, a special token's string in it is that token."""

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.added = [t for t in added if t]
        self.model, self.keep = self.whole.model, keep
        self.size = self.whole.get_vocab_size()
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        pre = json.loads(self.whole.pre_tokenizer.__getstate__()) if self.whole.pre_tokenizer else {}
        norm = json.loads(self.whole.normalizer.__getstate__()) if self.whole.normalizer else {}
        parts = pre.get("pretokenizers", [])
        self.cut = None
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
            self.cut, self.lower = re.compile(BYTE_CUT).findall, False
        elif (
            len(parts) == 2
            and parts[0].get("pattern", {}).get("Regex") == CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and parts[1]["type"] == "ByteLevel"
            and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        ):
            self.cut, self.lower = re.compile(WORD_CUT).findall, True
        self.plain = re.compile(PLAIN).fullmatch
        self.marks = byte_marks()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            ids = [t.id for t in self.model.tokenize(piece.translate(self.marks))]
            found = np.array(ids, self.type).tobytes()
        if len(self.young) >= self.keep:  # two generations: what is in use survives
            self.old, self.young = self.young, {}
        self.young[piece] = found
        return found

    def holds_added(self, text: str) -> bool:
        """Whether an added token's string may be in the text (in any case of its letters)."""
        low = text.lower()
        return any(t in low for t in self.added)

    def ids(self, text: str) -> np.ndarray:
        if self.cut is None or not self.plain(text) or self.holds_added(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.type)
        pieces = self.cut(text.lower() if self.lower else text)
        young = self.young
        try:
            return np.frombuffer(b"".join([young[p] for p in pieces]), self.type)
        except KeyError:
            out = []
            for p in pieces:
                found = self.young.get(p)
                out.append(self.piece(p) if found is None else found)
            return np.frombuffer(b"".join(out), self.type)


def encoder(path: str) -> Encoder:
    """One encoder per worker process; tasks that reuse the worker share what it remembers."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_leafwork_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
