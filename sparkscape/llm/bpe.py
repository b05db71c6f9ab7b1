"""Encoding of a corpus with a public byte-level BPE vocabulary.

Each piece of the splitting pattern is encoded by backtracking: an Aho-Corasick
automaton gives the longest token at every place; a token is taken only if it is
compatible with the one before, that is, if no merge would cross their border; if no
prefix of it fits, the encoder steps back and marks the place as dead. Every place dies
at most once, so time is linear in the text, and the result equals that of the merges.

The vocabulary is loaded once in each Python worker from a path on every machine.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 200_000  # pieces a worker remembers; forgetting costs time only
REMEMBERED_LENGTH = 64
PAIRS = 1_000_000  # pairs of tokens whose compatibility a worker remembers
NEVER = 1 << 60


class Encoder:
    """Exact BPE by backtracking over longest matches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.split = regex.compile(pattern).findall
        tokens = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        self.rank = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.sizes = [len(t) for t in tokens]
        # Decoding: all tokens in one string, and where each begins.
        self.blob = b"".join(tokens)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).tolist()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.rank.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [self._longest_prefix(t) for t in self.rank]
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}
        # Holders of a token's right and left edge, from the token itself down to a byte.
        self.right: list[tuple[int, ...]] = []
        self.left: list[tuple[int, ...]] = []
        for t, i in self.rank.items():
            a, b = self._halves(t, i)
            one = self.sizes[i] == 1
            self.right.append((i,) if one else (i, *self.right[b]))
            self.left.append((i,) if one else (i, *self.left[a]))
            if not one:
                self.merged[a, b] = i
        self.known: dict[str, tuple] = {}

    def _longest_prefix(self, t: str) -> int:
        for n in range(len(t) - 1, 0, -1):
            got = self.rank.get(t[:n])
            if got is not None:
                return got
        return -1

    def _halves(self, t: str, i: int) -> tuple[int, int]:
        """The two tokens whose merge is token i: the only compatible pair of older ones."""
        if len(t) == 1:
            return i, i
        for n in range(1, len(t)):
            a, b = self.rank.get(t[:n], i), self.rank.get(t[n:], i)
            if a < i and b < i and self._apart(a, b):
                return a, b
        raise ValueError(f"token {i} can't be reached by merges")

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes give just a, b; looked up in the table of pairs, which fills as pairs come."""
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            got = self._apart(a, b)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b.

        While a is built, its right edge is held by one token after the other: the last byte, then what
        it becomes, up to a; each from its own merge until the next one's. The same holds for b's left edge.
        A pair of holders that is itself merged crosses the border if its turn comes while both are there;
        at equal turns the pair further left goes first, so a's own merge does and b's doesn't.
        """
        merged, left = self.merged, self.left[b]
        until_a = NEVER
        for x in self.right[a]:
            until_b = NEVER
            for y in left:
                turn = merged.get((x, y), NEVER)
                if turn < until_a and turn <= until_b:
                    return False
                until_b = y
            until_a = x
        return True

    def piece(self, text: str) -> tuple:
        """Ids of one piece."""
        s = text.encode("utf-8").decode("latin-1")
        whole = self.rank.get(s)
        if whole is not None:
            return (whole,)
        n, sizes, shorter, compatible = len(s), self.sizes, self.shorter, self.compatible
        longest = [-1] * n
        for end, tok in self.automaton.iter(s):  # ends rise, so the last one kept at a start is the longest
            longest[end + 1 - sizes[tok]] = tok
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, tok = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while tok >= 0:
                end = at + sizes[tok]
                if alive[end] and (last < 0 or compatible(last, tok)):
                    break
                tok = shorter[tok]
            if tok >= 0:
                out.append(tok)
                at = end
                tok = longest[at] if at < n else -1
            else:
                alive[at] = 0
                tok = out.pop()
                at -= sizes[tok]
        return tuple(out)

    def encode(self, text: str | None) -> array:
        """Ids of a text without special tokens; none for null and empty texts."""
        ids = array("i")
        if not text:
            return ids
        known = self.known
        for p in self.split(text):
            got = known.get(p)
            if got is None:
                got = self.piece(p)
                if len(p) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = got
            ids.extend(got)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        blob, at = self.blob, self.offsets
        return b"".join(blob[at[i] : at[i + 1]] for i in ids).decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(read_ranks(path))


def encode_column(e: Encoder, texts: list) -> pa.ListArray:
    values, ends = array("i"), [0]
    for t in texts:
        values.extend(e.encode(t))
        ends.append(len(values))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, dtype=np.int32) if values else [], pa.int32()))


def ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every row; null and empty texts have the empty list.

    Strings of special tokens are ordinary text. Repeated rows stay repeated.
    """

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), encode_column(e, b.column(1).to_pylist())], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def lengths(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every row; 0 for null and empty texts."""

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(e.encode(t)) for t in b.column(1).to_pylist()], pa.int32())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens int")


def decoded(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, decoded: the text of doc_id, ids rows; null ids give the empty text."""

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded string")
