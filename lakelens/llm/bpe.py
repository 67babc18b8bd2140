"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that pyahocorasick's trie bounds the
longest vocabulary token at any place of a piece. A piece is encoded left to right with
the longest match at each position; a token is accepted only if it can stand
beside the token before it in a merge-by-rank result. That test is memoised per
pair, positions from which no completion exists are marked, and so each piece
takes linear time and gives exactly the merges of the rank table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, slices

#: Entries kept in each of a task's two caches, the longest text of an entry, and the pairs of tokens it keeps.
CACHE_PIECES, CACHE_CHARS, CACHE_PAIRS = 400_000, 40, 250_000
_STOPS = frozenset(",.;:!?")
_two_blanks = regex.compile(r"\s\s").search


class _Cache(dict):
    """Text -> packed ids, filled on demand and emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for b, r in self.ranks.items():
            self.tokens[r] = b
        self.split = regex.compile(pattern).findall
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        reachable = set()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            pair = self._last_merge(token, rank) if len(token) > 1 else None
            if len(token) > 1 and pair is None:
                continue  # no merge order makes it; it only stands for a whole piece
            self.parts[rank] = pair
            if pair:
                self.merged[pair] = rank
            reachable.add(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = {self.ranks[t]: next((self.ranks[t[:i]] for i in range(len(t) - 1, 0, -1) if t[:i] in reachable), -1) for t in reachable}
        self.latin = {t.decode("latin-1"): self.ranks[t] for t in reachable}
        self.most = max(map(len, reachable), default=1)
        self.length = {self.ranks[t]: len(t) for t in reachable}
        self.beside: dict[tuple[int, int], bool] = {}
        self.pieces = _Cache(lambda x: struct_pack(self.encode_piece(x.encode("utf-8", "surrogatepass"))))
        self.words = _Cache(self._after_blank)
        #: With these patterns a piece always begins at a blank between two other characters.
        self.by_blank = pattern.endswith(r"\s+(?!\S)|\s+") and " ?" in pattern

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token`` when its bytes are merged by rank."""
        ranks, word = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(word) > 2:
            found = min(((r, i) for i in range(len(word) - 1) if (r := ranks.get(word[i] + word[i + 1])) is not None and r < rank), default=None)
            if found is None:
                return None
            word[found[1] : found[1] + 2] = [word[found[1]] + word[found[1] + 1]]
        return (ranks[word[0]], ranks[word[1]]) if all(w in ranks for w in word) else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between the two tokens.

        Undo the younger of the two tokens' merges step by step and ask whether
        the pair then at the border would have merged before that step.
        """
        key = (left, right)
        if (known := self.beside.get(key)) is not None:
            return known
        parts, merged, bound, strict = self.parts, self.merged, 1 << 60, True
        while True:
            m = merged.get((left, right))
            if m is not None and (m < bound or (not strict and m == bound)):
                ok = False
                break
            # merges run by rank, then left to right: an equal rank on the right comes later
            a, b = parts[left], parts[right]
            if a is None and b is None:
                ok = True
                break
            if b is None or (a is not None and left > right):
                bound, strict, left = left, True, a[1]
            else:
                bound, strict, right = right, False, b[0]
        if len(self.beside) >= CACHE_PAIRS:
            self.beside.clear()
        self.beside[key] = ok
        return ok

    def _longest(self, text: str, at: int) -> int:
        """Rank of the longest token at this place; -1 if there is none."""
        ahead = text[at : at + self.most]
        for n in range(self.automaton.longest_prefix(ahead), 0, -1):
            if (rank := self.latin.get(ahead[:n])) is not None:
                return rank
        return -1

    def _after_blank(self, word: str) -> bytes:
        """Ids of a blank and the text up to the next blank."""
        if word.isalpha():
            return self.pieces.encode(" " + word)  # kept once, as a word
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return self.words[word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(" " + word)))

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if not data:
            return []
        length, shorter, compatible = self.length, self.shorter, self.compatible
        text = data.decode("latin-1")
        dead = bytearray(len(data) + 1)
        out: list[int] = []
        at, token = 0, self._longest(text, 0)
        while at < len(data):
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = self._longest(text, at)
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as packed little-endian unsigned 32-bit integers."""
        if not self.by_blank or _two_blanks(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.pieces.__getitem__, self.split(first))) + b"".join(map(self.words.__getitem__, rest))

    def forget(self) -> None:
        """Empty the caches: a worker that waits or serves another stage holds only the vocabulary."""
        for known in (self.pieces, self.words, self.beside):  # what is left of one holds the others' memory pages
            known.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def struct_pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row per input row: the id column, ``ids`` (binary: packed
    little-endian unsigned 32-bit token ids) and ``decoded`` (binary: the bytes
    those ids stand for). A null text counts as empty and gives two empty
    binaries; texts of any length are encoded whole; special tokens are ordinary
    text; extra columns are ignored; repeated rows and rows without an id are
    encoded alike; an empty table gives an empty result. ``path`` must be readable on every worker.
    """
    importable(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        try:
            for b in slices(batches):
                ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())], names=["id", "ids", "decoded"])
        finally:
            c.forget()

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token counts and SHA-256 digests of what ``encode_decode`` returns."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
