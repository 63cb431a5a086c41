"""Token ids of whole texts by a public tokenizer file, with a cache of word pieces.

The word-level tokenizers split a text by a pattern before any merge, so a piece's ids never depend on its
neighbours. Texts of plain Latin characters are split by an equal pattern here and looked up; every piece that is
new, and every text with any other character or a special token's string, goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from ._common import only_cache

#: Characters whose case folding, normal form and class are the same in every library that takes part.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-įĴ-ķĹ-ľŁ-ňŊ-ŷ]")
_LETTERS = "a-zß-öø-ŷ"
#: Pieces of each of the two generations of a worker's cache; what is met again moves to the young one.
_CACHED = 400_000


class WordTokenizer:
    """``ids(text)``: little-endian unsigned 32-bit ids, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        normal = [{k: v for k, v in n.items() if v is not None} for n in (spec.get("normalizer") or {}).get("normalizers", ())]
        blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        given = split.get("pattern", {}).get("Regex", "")
        end = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        #: Only a tokenizer of exactly this form is split here; any other encodes whole texts.
        self.fast = normal == [{"type": "NFC"}, blanks, {"type": "Lowercase"}] and given.endswith(end) and split.get("invert") and all(
            re.fullmatch(r"'[a-z]+", x) for x in given.removesuffix(end).strip("|").split("|")
        )
        self.find = re.compile(given.removesuffix(end) + rf"[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+").findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Look up new pieces in one call: joined by blanks they stay the words that they are, and each id names its word."""
        encoding = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        ids, word = np.array(encoding.ids, dtype="<u4"), np.array(encoding.word_ids, dtype=np.int64)
        if len(ids) and word[-1] != len(pieces) - 1:
            raise RuntimeError("the tokenizer parts words in another way")
        data, ends = ids.tobytes(), (4 * np.searchsorted(word, np.arange(len(pieces)), side="right")).tolist()
        start = 0
        for piece, end in zip(pieces, ends, strict=True):
            self.young[piece] = data[start:end]
            start = end

    def ids(self, text: str) -> bytes:
        if not self.fast or _PLAIN.search(text) or any(s in text for s in self.special):
            return self._encode(text)
        found, young = self.find(text.lower()), self.young
        if missing := [x for x in set(found) if x not in young]:
            new = [x for x in missing if x not in self.old]
            young.update((x, self.old[x]) for x in missing if x in self.old)
            if new:
                self._learn(new)
        out = b"".join([young[x] for x in found])
        if len(young) > _CACHED:
            self.old, self.young = young, {}
        return out


def load(path: str) -> WordTokenizer:
    """The tokenizer of a file, once per process. A bare name is looked up among the public tokenizers."""
    loaded = only_cache("tokenizers")
    if path not in loaded:
        at = path
        if "/" not in path:
            import public_tokenizers

            at = public_tokenizers.path(path)
        loaded[path] = WordTokenizer(at)
    return loaded[path]
