"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own hashed vector plus the mean of the hashed vectors of
its runs of 3 to 5 bytes, with the spaces around it, so that changed spellings
share most of their input. Two gated recurrent layers read a window of words
from either side; attention weighs the words' states; a logistic unit scores.
All overlapping windows of a text are scored and the highest counts.

The network is trained in numpy on a bounded sample of labelled texts
(`SAMPLE` for each label, the first by a hash of their ids). A label belongs to a text, not to a
window: at first the windows with the words most typical of toxic texts stand
for a text, then those that the network scores highest, also the worst ones of
texts that aren't toxic.

Null texts count as empty. A text without words scores as a window of padding.
Repeated rows score alike, other columns are never read. Without any toxic or
any other labelled text, the score is 0 for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, text_blocks
from .shingles import _BASE, _LOWER, _SPACE, _powers, mixed

SAMPLE = {0: 3000, 1: 1500}
WINDOW, STRIDE = 24, 12
WORD_SLOTS, RUN_SLOTS = 1 << 14, 1 << 14
INPUT, HIDDEN, ATTENTION = 12, 8, 8
RUNS = (3, 4, 5)
ROUNDS, STEPS, BATCH, RATE = 5, 90, 192, 0.01
#: Share of words whose own vector is left out of a training step.
DROPPED = 0.6
FOLDS, HELD_OUT = 5, 0
assert _BASE % 2  # has an inverse modulo 2**64


@dataclass
class Words:
    """The distinct words of some texts, and the texts as their numbers."""

    hashes: np.ndarray
    runs: np.ndarray  # slots of the words' runs of bytes, word after word
    run_counts: np.ndarray
    ids: np.ndarray
    counts: np.ndarray  # words of each text

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        joined = b"\n".join([b"", *texts, b""])
        raw = np.frombuffer(joined.translate(_LOWER), np.uint8)
        space = _SPACE[raw]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        up, down = _powers(1 << max(21, int(len(raw)).bit_length()))
        plain = np.where(space, 32, raw).astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(plain * up[: len(raw)])])
        hashes = mixed((total[ends] - total[starts]) * down[starts])
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        counts = np.diff(np.searchsorted(starts, begins))
        distinct, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = starts[first] - 1, ends[first] + 1  # with the spaces
        slots, owners = [], []
        for n in RUNS:
            m = np.maximum(b - a - n + 1, 0)
            owner = np.repeat(np.arange(len(a)), m)
            at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(a, m)
            h = mixed((total[at + n] - total[at]) * down[at] + np.uint64(n))
            slots.append((h % np.uint64(RUN_SLOTS)).astype(np.int64))
            owners.append(owner)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return cls(distinct, np.concatenate(slots)[order], np.bincount(owner, minlength=len(a)), ids, counts)

    @classmethod
    def joined(cls, texts: list[bytes], limit: int = 1_000_000) -> Words:
        """Of many texts, block by block, so that memory stays small."""
        parts, block, size = [], [], 0
        for t in texts:
            if block and size + len(t) > limit:
                parts.append(cls.of(block))
                block, size = [], 0
            block.append(t)
            size += len(t) + 1
        parts.append(cls.of(block))
        hashes, first, ids = np.unique(np.concatenate([w.hashes for w in parts]), return_index=True, return_inverse=True)
        begin = np.cumsum([0, *(len(w.hashes) for w in parts)])
        all_counts = np.concatenate([w.run_counts for w in parts])
        whole = cls(hashes, np.concatenate([w.runs for w in parts]), all_counts, np.zeros(0, np.int64), np.zeros(0, np.int64))
        runs, run_counts = whole.runs_of(first)
        numbers = np.concatenate([ids[b + w.ids] for b, w in zip(begin, parts, strict=False)])
        return cls(hashes, runs, run_counts, numbers, np.concatenate([w.counts for w in parts]))

    def runs_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.cumsum(self.run_counts) - self.run_counts
        m = self.run_counts[words]
        return self.runs[np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[words], m)], m

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of every window (the number past the last word pads), and windows of each text."""
        n = np.maximum(-(-(self.counts - WINDOW) // STRIDE), 0) + 1
        begin = np.cumsum(self.counts) - self.counts
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = at[:, None] * STRIDE + np.arange(WINDOW)[None, :]
        inside = place < np.repeat(self.counts, n)[:, None]
        ids = np.append(self.ids, len(self.hashes))
        return np.where(inside, ids[np.where(inside, place + np.repeat(begin, n)[:, None], 0)], len(self.hashes)), n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name, the forward pass and its gradients."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, INPUT
        shapes = {"word": (WORD_SLOTS, d), "run": (RUN_SLOTS, d), "a": (2 * h, ATTENTION), "av": (ATTENTION,), "o": (2 * h,), "ob": (1,), "ab": (ATTENTION,)}
        for side in "fb":
            shapes |= {f"x{side}": (d, 3 * h), f"h{side}": (h, 3 * h), f"c{side}": (3 * h,)}
        scale = {"word": 0.1, "run": 0.3}
        self.p = {k: (rng.standard_normal(s) * scale.get(k, 0.35)).astype(np.float32) for k, s in shapes.items()}
        for k in ("ob", "ab", "cf", "cb"):
            self.p[k][:] = 0

    def inputs(self, w: Words, dropped: np.ndarray | None = None) -> np.ndarray:
        """A vector for each distinct word, and zeros for padding; `dropped` words show their runs only."""
        out = np.zeros((len(w.hashes) + 1, INPUT), np.float32)
        if len(w.hashes):
            out[:-1] = self.p["word"][(w.hashes % np.uint64(WORD_SLOTS)).astype(np.int64)]
            if dropped is not None:
                out[:-1][dropped] = 0
            ends = np.cumsum(w.run_counts)
            for i in range(0, len(w.hashes), 20_000):
                m = w.run_counts[i : i + 20_000]
                has = np.flatnonzero(m)
                if len(has):
                    runs = self.p["run"][w.runs[ends[i] - m[0] : ends[i + len(m) - 1]]]
                    out[i + has] += np.add.reduceat(runs, (np.cumsum(m) - m)[has], axis=0) / m[has, None]
        return out

    def states(self, gates: dict[str, np.ndarray], at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Both layers' states for windows of word numbers; `keep` gathers what gradients need."""
        h = HIDDEN
        out = np.empty((len(at), WINDOW, 2 * h), np.float32)
        for side, steps, place in (("f", range(WINDOW), slice(0, h)), ("b", range(WINDOW - 1, -1, -1), slice(h, None))):
            state = np.zeros((len(at), h), np.float32)
            for t in steps:
                gx, gh = gates[side][at[:, t]], state @ self.p[f"h{side}"]
                zr = _sigmoid(gx[:, : 2 * h] + gh[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(gx[:, 2 * h :] + r * gh[:, 2 * h :])
                if keep is not None:
                    keep.append((side, t, state, z, r, n, gh[:, 2 * h :]))
                state = n + z * (state - n)
                out[:, t, place] = state
        return out

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {side: x @ self.p[f"x{side}"] + self.p[f"c{side}"] for side in "fb"}

    def pooled(self, states: np.ndarray, pad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        inner = np.tanh(states @ self.p["a"] + self.p["ab"])
        e = inner @ self.p["av"] + np.where(pad, np.float32(-1e4), np.float32(0))
        weight = np.exp(e - e.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        context = np.einsum("bt,bth->bh", weight, states)
        return inner, weight, context, context @ self.p["o"] + self.p["ob"][0]

    def logits(self, w: Words, at: np.ndarray) -> np.ndarray:
        """A score before the logistic function for each window."""
        gates, out = self.gates(self.inputs(w)), np.empty(len(at), np.float32)
        for a in range(0, len(at), 1024):
            part = at[a : a + 1024]
            out[a : a + 1024] = self.pooled(self.states(gates, part), part == len(w.hashes))[3]
        return out

    def gradients(self, w: Words, at: np.ndarray, label: np.ndarray, dropped: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over some windows, with some words' own vectors left out."""
        h, p, kept = HIDDEN, self.p, []
        g = {k: np.zeros_like(v) for k, v in p.items()}
        x = self.inputs(w, dropped)
        states = self.states(self.gates(x), at, kept)
        inner, weight, context, logit = self.pooled(states, at == len(w.hashes))
        d = ((_sigmoid(logit) - label) / len(at)).astype(np.float32)
        g["o"], g["ob"] = context.T @ d, np.array([d.sum()], np.float32)
        d_context = d[:, None] * p["o"]
        d_states = weight[:, :, None] * d_context[:, None, :]
        d_weight = np.einsum("bth,bh->bt", states, d_context)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["av"] = np.einsum("bta,bt->a", inner, d_e)
        d_inner = d_e[:, :, None] * p["av"] * (1 - inner**2)
        g["a"], g["ab"] = np.einsum("bth,bta->ha", states, d_inner), d_inner.sum(axis=(0, 1))
        d_states += d_inner @ p["a"].T
        d_x = np.zeros_like(x)
        carry = {s: np.zeros((len(at), h), np.float32) for s in "fb"}
        for side, t, state, z, r, n, gh in reversed(kept):
            ds = carry[side] + d_states[:, t, :h] if side == "f" else carry[side] + d_states[:, t, h:]
            dz = ds * (state - n) * z * (1 - z)
            dn = ds * (1 - z) * (1 - n * n)
            dr = dn * gh * r * (1 - r)
            into_x, into_h = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
            g[f"h{side}"] += state.T @ into_h
            g[f"c{side}"] += into_x.sum(axis=0)
            g[f"x{side}"] += x[at[:, t]].T @ into_x
            np.add.at(d_x, at[:, t], into_x @ p[f"x{side}"].T)
            carry[side] = ds * z + into_h @ p[f"h{side}"].T
        if len(w.hashes):
            np.add.at(g["word"], (w.hashes % np.uint64(WORD_SLOTS)).astype(np.int64), np.where(dropped[:, None], 0, d_x[:-1]))
            np.add.at(g["run"], w.runs, np.repeat(d_x[:-1] / np.maximum(w.run_counts, 1)[:, None], w.run_counts, axis=0))
        return g

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window of each text, as a probability."""
        w = Words.of([t.encode() for t in texts])
        at, n = w.windows()
        return _sigmoid(np.maximum.reduceat(self.logits(w, at), np.cumsum(n) - n).astype(np.float64))


class _Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in self.p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] ** 2 - self.v[k])
            x -= RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _narrowed(w: Words, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of some windows alone."""
    used, back = np.unique(at, return_inverse=True)
    used = used[used < len(w.hashes)]
    runs, m = w.runs_of(used)
    return Words(w.hashes[used], runs, m, np.zeros(0, np.int64), np.zeros(0, np.int64)), back.reshape(at.shape)


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> Network | None:
    """A network from texts and their labels; None if only one label occurs."""
    if len(set(labels.tolist())) < 2:
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    w = Words.joined([t.encode() for t in texts])
    at, n = w.windows()
    owner = np.repeat(np.arange(len(texts)), n)
    text_of_word = np.repeat(np.arange(len(texts)), w.counts)
    pairs = np.unique(text_of_word * np.int64(len(w.hashes) + 1) + w.ids)
    toxic = labels[pairs // (len(w.hashes) + 1)] == 1
    word = pairs % (len(w.hashes) + 1)
    hit, miss = (np.bincount(word[k], minlength=len(w.hashes) + 1) for k in (toxic, ~toxic))
    typical = np.log((hit + 0.5) / (labels.sum() + 1)) - np.log((miss + 0.5) / ((1 - labels).sum() + 1))
    typical = np.where(hit >= 2, typical, 0)
    value = typical[at].max(axis=1)
    first = np.cumsum(n) - n
    adam = _Adam(net.p)
    bad, good = (np.flatnonzero(labels == y) for y in (1, 0))
    best = np.lexsort((np.arange(len(value)), -value, owner))[first]  # the highest window of each text
    known = bad[np.maximum.reduceat(value, first)[bad] > 1]
    positives = best[known if len(known) else bad]
    negatives = np.concatenate([best[good], rng.choice(np.flatnonzero(labels[owner] == 0), min(4000, int((labels[owner] == 0).sum())), replace=False)])
    for turn in range(ROUNDS):
        for _ in range(STEPS):
            some = np.concatenate([rng.choice(positives, BATCH // 3), rng.choice(negatives, BATCH - BATCH // 3)])
            part, ids = _narrowed(w, at[some])
            adam.step(net.gradients(part, ids, labels[owner[some]].astype(np.float32), rng.random(len(part.hashes)) < DROPPED))
        if turn + 1 < ROUNDS:
            value = net.logits(w, at)
            best = np.lexsort((np.arange(len(value)), -value, owner))[first]
            positives = best[bad]
            worst = np.argsort(-np.where(labels[owner] == 0, value, -np.inf))[:2000]
            negatives = np.concatenate([negatives, best[good], worst[labels[owner[worst]] == 0]])
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """From documents with a label whose id isn't in the held-out fold.

    `labels` may repeat an id; its greatest label counts. Null labels count as none.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("toxic").alias("label"))
    )
    chosen = None
    for label, most in SAMPLE.items():
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    rows = {r["id"]: r["label"] for r in chosen.collect() if r["id"] is not None}
    if not rows:
        return None
    # The sample is bounded, so its ids can be part of the scan's filter.
    picked = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(rows)))
    texts = sorted({(r["doc_id"], r["text"] or "") for r in picked.collect()})
    return train([t for _, t in texts], np.array([rows[i] for i, _ in texts], np.int64))


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=1_000_000):
            texts = [t or "" for t in block.column("text").to_pylist()]
            s = shared.value.score(texts) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(s)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
