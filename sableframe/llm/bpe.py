"""Byte-level BPE: speculate with longest matches, verify pairs, merge the rest.

A text is cut into pieces by the vocabulary's pattern. For the pieces that a
worker meets for the first time, longest-match tokens are proposed. A sequence
of tokens is what BPE gives if and only if every adjacent pair, encoded alone,
stays that pair; numpy tests all pairs of a block at once. Only pieces with a
failing pair go through exact merging by rank.

Null texts count as empty and give no tokens. A special token's string inside a
text is that token, as the tokenizers library has it by default.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_blocks

#: The vocabulary's cutting pattern, fixed. White space is listed, since
#: libraries differ in what \s covers.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
#: Pieces kept by a worker; beyond that it starts afresh.
CACHE_PIECES = 250_000


def _byte_chars() -> dict[str, int]:
    """The vocabulary's letters for bytes: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the tables for testing pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_chars()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(letters[c] for c in word): i for word, i in vocab.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for word, i in self.ids.items():
            self.bytes[i] = word
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.reach: dict[bytes, int] = {}  # the longest token by its first three bytes
        for word in self.ids:
            self.reach[word[:3]] = max(self.reach.get(word[:3], 0), len(word))
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges))
        self.made = made
        # A token is built by the first merge that makes it; single bytes by none.
        self.built = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        first = np.unique(made, return_index=True)
        self.built[first[0]] = rank[first[1]]
        self.left[first[0]], self.right[first[0]] = left[first[1]], right[first[1]]
        keys = left * size + right
        order = np.argsort(keys)
        self.keys, self.key_rank, self.size = keys[order], rank[order], size
        self.pieces: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def longest_match(self, piece: bytes) -> list[int]:
        out, at, ids, n = [], 0, self.ids, len(piece)
        while at < n:
            for end in range(min(n, at + self.reach.get(piece[at : at + 3], 2)), at, -1):
                if (i := ids.get(piece[at:end])) is not None:
                    break
            out.append(i)
            at = end
        return out

    def stable_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, encoded as one piece, stays that pair.

        Both tokens are taken apart from the border outwards, the younger half
        first. A merge across the border that comes before the younger of the
        two halves was complete would have taken place, so the pair falls.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)  # merges across count if of lower rank
        ties = np.zeros(len(a), bool)  # or of the same rank, if the left one is the younger
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            across = np.where(self.keys[at] == key, self.key_rank[at], np.iinfo(np.int64).max)
            falls = (across < limit) | (ties & (across == limit))
            ok[live[falls]] = False
            ra, rb = self.built[a], self.built[b]
            go = ~falls & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            by_left = ra > rb
            limit = np.where(by_left, ra, rb)
            ties = ~by_left
            a = np.where(by_left, self.right[a], a)
            b = np.where(by_left, b, self.left[b])
        return ok

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Exact merging of many pieces at once: each round, every piece merges
        its pair of lowest rank wherever it stands, from the left."""
        single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        out: list[list[int]] = [[] for _ in pieces]
        ids = single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        none = len(self.key_rank)
        while len(ids):
            key = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.key_rank[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(rank, starts)
            done = best == none
            for i in np.flatnonzero(done).tolist():
                out[owner[starts[i]]] = ids[starts[i] : starts[i] + sizes[i]].tolist()
            joins = (rank == np.repeat(best, sizes)) & (rank < none)
            # Of overlapping equal pairs (aaa) every other one merges.
            where = np.flatnonzero(joins)
            if not len(where):
                break
            run = np.append(True, np.diff(where) != 1)
            run_at = np.flatnonzero(run)
            where = where[(np.arange(len(where)) - np.repeat(run_at, np.diff(np.append(run_at, len(where))))) % 2 == 0]
            ids[where] = self.made[rank[where]]
            stays = ~np.repeat(done, sizes)
            stays[where + 1] = False
            ids, owner = ids[stays], owner[stays]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces into the cache."""
        raw = [p.encode() for p in pieces]
        proposed = [self.longest_match(p) for p in raw]
        flat = np.array([i for ids in proposed for i in ids], np.int64)
        ends = np.cumsum([len(ids) for ids in proposed])
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False  # no pair goes over the end of a piece
        at = np.flatnonzero(inner)
        pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        good = self.stable_pairs(pairs // self.size, pairs % self.size)[back]
        failed = np.unique(np.searchsorted(ends, at[~good], side="right")).tolist()
        for k, ids in zip(failed, self.merge([raw[k] for k in failed]), strict=True):
            proposed[k] = ids
        lengths = [4 * len(ids) for ids in proposed]
        packed = np.array([i for ids in proposed for i in ids], "<u4").tobytes()
        end = 0
        for piece, length in zip(pieces, lengths, strict=True):
            self.pieces[piece] = packed[end : end + length]
            end += length

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t] for t in texts]
        cut = [[[p] if i % 2 else self.find(p) for i, p in enumerate(ps)] for ps in parts]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        new = {p for ps in cut for i, words in enumerate(ps) if i % 2 == 0 for p in words if p not in self.pieces}
        if new:
            self.learn(list(new))
        get = self.pieces.__getitem__
        return [
            b"".join([np.array([self.special[words[0]]], "<u4").tobytes() if i % 2 else b"".join(map(get, words)) for i, words in enumerate(ps)])
            for ps in cut
        ]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text (doc_id, text): counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_path())  # each worker finds its own file
        for block in text_blocks(batches, limit=1_000_000):
            ids = v.encode_block([t or "" for t in block.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").cast(pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids as an array, for a training set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_path())  # each worker finds its own file
        for block in text_blocks(batches, limit=1_000_000):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in v.encode_block([t or "" for t in block.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def default_path() -> str:
    """The public vocabulary's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
