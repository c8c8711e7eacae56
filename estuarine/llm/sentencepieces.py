"""Byte-pair encoding and decoding with a SentencePiece model, by vectorised merge rounds.

All distinct words of a block of texts are encoded at once. Their symbols lie in one flat array.
A round finds the best pair of each word (a segmented minimum), merges its leftmost occurrence
in all words at the same time and compacts the array; words without a pair left drop out.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.llm.common import slices, starts, strings

SPACE_MARK = "▁"
NONE = np.iinfo(np.int64).max


class PieceModel:
    """The merge table of a model file: BPE with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != model.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only BPE models that keep texts as they are can be used here")
        kinds = model.ModelProto.SentencePiece
        pieces = list(proto.pieces)
        self.text = [p.piece if p.type == kinds.NORMAL else "" for p in pieces]
        self.id = {p.piece: i for i, p in enumerate(pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == kinds.BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        if len(self.byte) < 256 or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in pieces):
            raise ValueError("the model needs all byte pieces and no pieces of the user")
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id):
            raise ValueError("a piece runs over the start of a word")
        self.end = proto.trainer_spec.eos_id
        #: per id its text in UTF-8 and its number with a space
        self.raw = [bytes([self.value[i]]) if i in self.value else x.encode() for i, x in enumerate(self.text)]
        self.printed = [b"%d " % i for i in range(len(pieces))]
        #: the better the score, the lower the rank; equal scores share one, then the left pair goes first
        order = {s: r for r, s in enumerate(sorted({p.score for p in pieces}, reverse=True))}
        found = [(self.id[p[:i]], self.id[p[i:]], order[pieces[n].score], n) for p, n in self.id.items() for i in range(1, len(p)) if p[:i] in self.id and p[i:] in self.id]
        self.size = len(pieces) + 0x110000  # characters without a piece follow the pieces
        keys = np.array([a * self.size + b for a, b, _, _ in found], np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.ranks = np.array([r for _, _, r, _ in found], np.int64)[by]
        self.merged = np.array([n for _, _, _, n in found], np.int64)[by]
        self.table = {(a, b): (r, n) for a, b, r, n in found}

    def symbols(self, word: str) -> list[int]:
        return [self.id[c] if c in self.id else len(self.text) + ord(c) for c in word]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where they don't merge."""
        if not len(left) or not len(self.keys):
            return np.full(len(left), NONE), np.zeros(len(left), np.int64)
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = self.keys[at] == want
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], 0)

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        """The symbols of every word after all merges."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = np.fromiter((s for w in words for s in w), np.int64, int(lengths.sum()))
        name = np.flatnonzero(lengths)  # the words still at work
        lengths = lengths[name]

        def ranked(at: np.ndarray) -> None:
            """Look the pairs at these places up again."""
            inside = at[word[at] == word[np.minimum(at + 1, len(word) - 1)]]
            inside = inside[inside < len(word) - 1]
            rank[at] = NONE
            rank[inside], result[inside] = self.pairs(symbol[inside], symbol[inside + 1])

        word = np.repeat(np.arange(len(name)), lengths)
        rank, result = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int64)
        ranked(np.arange(len(symbol)))
        while len(name):
            at = starts(lengths)
            best = np.minimum.reduceat(rank, at[:-1])
            done = best == NONE
            if done.any():
                kept = done[word]
                flat, edges = symbol[kept].tolist(), starts(lengths[done]).tolist()
                for i, a, b in zip(name[done].tolist(), edges[:-1], edges[1:], strict=True):
                    out[i] = flat[a:b]
                symbol, rank, result = symbol[~kept], rank[~kept], result[~kept]
                name, lengths, best = name[~done], lengths[~done], best[~done]
                word = np.repeat(np.arange(len(name)), lengths)
                if not len(name):
                    break
            here = np.flatnonzero(rank == best[word])
            here = here[np.diff(word[here], prepend=-1) != 0]  # leftmost of each word
            symbol[here] = result[here]
            keep = np.ones(len(symbol), bool)
            keep[here + 1] = False
            symbol, rank, result, word = symbol[keep], rank[keep], result[keep], word[keep]
            lengths = lengths - 1  # every word at work has merged one pair
            here = here - np.arange(len(here))
            ranked(np.unique(np.concatenate([here, np.maximum(here - 1, 0)])))
        return out

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges in the same order for one long word, with a queue of its pairs."""
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        symbols, queue = list(symbols), []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (found := self.table.get((symbols[i], symbols[right[i]]))):
                heapq.heappush(queue, (found[0], i, symbols[i], symbols[right[i]], found[1]))

        for i in range(len(symbols)):
            offer(i)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two is part of another piece by now
            symbols[i], symbols[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            offer(i)
            offer(left[i])
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str], long: int = 200) -> list[list[int]]:
        """Ids of distinct words; words beyond `long` symbols take the queue, with equal results."""
        symbols = [self.symbols(w) for w in words]
        merged = self.merge([s if len(s) <= long else [] for s in symbols])
        base = len(self.text)
        out = []
        for s, m in zip(symbols, merged, strict=True):
            m = self.merge_long(s) if len(s) > long else m
            if m and max(m) >= base:
                m = [y for x in m for y in ([x] if x < base else [self.byte[b] for b in chr(x - base).encode()])]
            out.append(m)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8, with its space marks; control pieces give nothing."""
        return b"".join([self.raw[i] for i in ids])

    def digits(self, ids: list[int]) -> bytes:
        """The ids in decimal, each with a space behind it."""
        return b"".join([self.printed[i] for i in ids])

    @staticmethod
    def words(text: str) -> list[str]:
        """Stretches that begin with space marks; pieces never run over their starts."""
        return re.findall(f"{SPACE_MARK}+[^{SPACE_MARK}]*", SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []


def plain(decoded: bytes) -> bytes:
    """Decoded text as the library gives it: marks are spaces, the first one was added."""
    mark = SPACE_MARK.encode()
    return decoded.removeprefix(mark).replace(mark, b" ")


def encode(docs: DataFrame, path: str, with_ids: bool = False, limit: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), and the ids and the decoded text if asked for.

    Ids end with the model's end id. Whole texts are encoded; each task keeps the words it has
    met, up to `limit`, so that a distinct word goes through the merge rounds once.

    Null or empty text: the end id alone, decoded to the empty text. A null id stays null,
    repeated rows give repeated results, other columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        model = PieceModel(path)
        known: dict[str, tuple[int, bytes, bytes, list[int]]] = {}
        for batch in batches:
            for part in slices(batch, "__text"):
                if len(known) > limit:
                    known.clear()
                texts = [model.words(t) for t in strings(part, "__text")]
                new = [w for w in {w for t in texts for w in t} if w not in known]
                for w, ids in zip(new, model.encode_words(new), strict=True):
                    known[w] = len(ids), model.digits(ids), model.decode(ids), ids if with_ids else []
                rows = [[], [], [], [], []]
                for words in texts:
                    found = [known[w] for w in words]
                    decoded = plain(b"".join([x[2] for x in found]))
                    rows[0].append(sum([x[0] for x in found]) + 1)
                    rows[1].append(hashlib.sha256(b"".join([x[1] for x in found]) + str(model.end).encode()).hexdigest())
                    rows[2].append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        rows[3].append([*(i for x in found for i in x[3]), model.end])
                        rows[4].append(decoded.decode(errors="replace"))
                cols = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
                if with_ids:
                    cols += [pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(cols)])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    more = ", ids array<long>, decoded string" if with_ids else ""
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
