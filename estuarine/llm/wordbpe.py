"""Pieces of whole texts by way of their distinct pre-tokens.

A pre-token never crosses white space, so a text is split at white space, each distinct
stretch is cut into pre-tokens once, and each distinct pre-token is encoded once. Both
tables live as long as a task and are emptied beyond `limit` entries.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from estuarine.llm.common import ranges, starts

#: Fixed value: the pre-token pattern for which stretches between white space are independent.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: In these characters white space differs between the library and Python.
ODD = b"\x1c\x1d\x1e\x1f"


class WordPieces:
    """Encodes texts as the tokenizer file does, without added special tokens.

    Texts of Latin-1 characters take the route over distinct pre-tokens; for those their
    normal form is plain lower case. Any other text, a text with one of the file's special
    strings, and any text under a file with other rules goes to the library as a whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = limit
        kinds = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in (rules.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and [x["pattern"].get("Regex") for x in splits] == [PATTERN]
        specials = [x["content"] for x in rules.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        letters, digits, spaces = (
            "".join(re.escape(chr(c)) for c in range(256) if test(chr(c)))
            for test in (
                lambda c: unicodedata.category(c)[0] == "L",
                lambda c: unicodedata.category(c)[0] == "N",
                lambda c: c.isspace() and c.encode("latin-1") not in [bytes([b]) for b in ODD],
            )
        )
        self.cut = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{spaces}{letters}{digits}]+")
        # the byte alphabet of such files: printable bytes stand for themselves, the others follow 255
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        self.letters = {b: chr(256 + i) for i, b in enumerate(others)}
        self.clear()

    def clear(self) -> None:
        self.pre: dict[str, list[int]] = {}
        self.codes: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def _plain(self, text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return self.known and len(raw.translate(None, ODD)) == len(raw) and not self.special.search(text)

    def _encode(self, words: list[str]) -> None:
        """Pieces of new pre-tokens, by the file's merges on their bytes."""
        merges = self.tokenizer.model.tokenize
        for w in words:
            self.pre[w] = [x.id for x in merges(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters))]

    def _add(self, rows: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.uint32, int(lengths.sum()))
        self.flat = np.concatenate([self.flat, flat])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.first = starts(self.lengths)

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code of every stretch of the texts in order, and the number of stretches of each text."""
        if len(self.lengths) > self.limit:
            self.clear()
        parts: list[list] = []
        whole: list[str] = []
        for text in texts:
            if self._plain(text):
                parts.append(text.lower().split())
            else:
                parts.append([len(whole)])  # its place among the texts for the library
                whole.append(text)
        new = [w for w in {w for p in parts for w in p if isinstance(w, str)} if w not in self.codes]
        cuts = [self.cut.findall(w) for w in new]
        self._encode([w for w in {w for c in cuts for w in c} if w not in self.pre])
        base = len(self.lengths)
        self.codes.update(zip(new, range(base, base + len(new)), strict=True))
        base += len(new)
        rows = [[i for w in c for i in self.pre[w]] for c in cuts]
        rows += [x.ids for x in self.tokenizer.encode_batch(whole, add_special_tokens=False)] if whole else []
        if rows:
            self._add(rows)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = self.codes
        flat = np.fromiter((codes[w] if isinstance(w, str) else base + w for p in parts for w in p), np.int64, int(counts.sum())) if whole else np.fromiter(map(codes.__getitem__, (w for p in parts for w in p)), np.int64, int(counts.sum()))
        return flat, counts

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and the number of ids of each text."""
        codes, counts = self.lookup(texts)
        lengths = self.lengths[codes]
        upto = starts(lengths)
        return self.flat[ranges(self.first[codes], lengths)], np.diff(upto[starts(counts)])

    def sizes(self, texts: list[str]) -> np.ndarray:
        """Number of pieces of each text: pieces of each distinct stretch times its frequency there."""
        codes, counts = self.lookup(texts)
        width = max(len(self.lengths), 1)
        pairs, frequency = np.unique(np.repeat(np.arange(len(texts)), counts) * width + codes, return_counts=True)
        return np.bincount(pairs // width, weights=frequency * self.lengths[pairs % width], minlength=len(texts)).astype(np.int64)
