"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded: shares of character classes, word
shapes and repetition, and a histogram of hashed character trigrams go through a learned layer. A gated attention
(tanh times sigmoid) gives each passage a weight; the document's score is the logistic of the weighted mean. Only
document labels are known, and the attention is learned from them.

The model is fitted on the driver to a bounded sample: at most ``TRAIN_DOCUMENTS`` labelled documents with at most
``TRAIN_PASSAGES`` passages each, chosen by a hash of the id. Scoring covers all passages of every document.

Results for odd input: a null or empty text is one empty passage, which has a score like any other; rows of ``labels``
with a null id or label are ignored; an id that is labelled twice counts twice. Without labelled rows, or with one
class only, the score is the share of label 1 (0.5 without any). Equal texts get equal scores.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrank.llm.common import keyed_modulo, map_arrow

PASSAGE_WORDS = 64
#: Bounds of the training sample.
TRAIN_DOCUMENTS, TRAIN_PASSAGES = 3000, 128
TRIGRAM_BUCKETS = 64
ENCODED, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.01, 1e-4
SEED = 20240501
#: A document is predicted to be good from this score on.
THRESHOLD = 0.3
#: Characters featurised at once.
BLOCK_CHARS = 2_000_000
STATS = 14


@cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1 lower or caseless letter, 2 upper-case letter, 3 digit, 4 sentence punctuation, 5 other."""
    table = np.full(0x110000, 5, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] in "LM":
            table[point] = 2 if kind in ("Lu", "Lt") else 1
        elif kind[0] == "N":
            table[point] = 3
        elif kind[0] == "Z":
            table[point] = 0
    table[9:14] = 0
    for c in ".,;:!?'\"-()…’“”«»¿¡":
        table[ord(c)] = 4
    return table


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features, number of the text of each passage), passages in order."""
    joined = "\n".join([t or "" for t in texts]) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text_ends = np.cumsum(np.array([len(t) + 1 if t else 1 for t in texts], np.int64))
    kind = _classes()[points]
    inside = np.concatenate(([False], kind > 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    text = np.searchsorted(text_ends, starts, side="right")
    words_in = np.bincount(text, minlength=len(texts))
    passages_in = np.maximum(1, -(-words_in // PASSAGE_WORDS))
    first_passage = np.cumsum(passages_in) - passages_in
    rank = np.arange(len(starts)) - (np.cumsum(words_in) - words_in)[text]
    passage = first_passage[text] + rank // PASSAGE_WORDS
    n = int(passages_in.sum())
    bag = np.repeat(np.arange(len(texts)), passages_in)
    out = np.zeros((n, STATS + TRIGRAM_BUCKETS), np.float32)
    if not len(starts):
        return out, bag
    lengths = ends - starts
    words = np.bincount(passage, minlength=n)
    some = np.maximum(words, 1)
    chars = np.flatnonzero(kind)
    char_passage = np.repeat(passage, lengths)
    total = np.maximum(np.bincount(char_passage, minlength=n), 1)
    of_kind = np.bincount(char_passage * 6 + kind[chars], minlength=n * 6).reshape(n, 6) / total[:, None]
    out[:, 0:5] = of_kind[:, 1:6]
    out[:, 5] = np.bincount(passage, weights=lengths, minlength=n) / some / 10
    last, lead = kind[ends - 1], kind[starts]
    out[:, 6] = np.bincount(passage, weights=last == 5, minlength=n) / some
    out[:, 7] = np.bincount(passage, weights=last == 4, minlength=n) / some
    out[:, 8] = np.bincount(passage, weights=lead == 2, minlength=n) / some
    out[:, 9] = np.bincount(passage, weights=(lengths == 1) & (lead >= 4), minlength=n) / some
    # words as 64-bit sums of mixed (character, place) pairs
    place = np.arange(len(chars), dtype=np.uint64) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.uint64)
    mixed = (points[chars].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    word = np.add.reduceat(mixed, np.cumsum(lengths) - lengths)
    seen = word ^ (passage.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at = np.unique(seen, return_index=True)
    out[:, 10] = np.bincount(passage[at], minlength=n) / some
    pair = word[:-1] * np.uint64(3) + word[1:] ^ (text[1:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at = np.unique(pair, return_index=True)
    fresh = np.zeros(len(word), bool)
    fresh[at + 1] = True
    fresh[rank == 0] = True
    out[:, 11] = np.bincount(passage, weights=fresh, minlength=n) / some  # word pairs that the document has not had before
    out[:, 12] = np.log1p(words) / 5
    out[:, 13] = (np.log1p(words_in) / 10)[bag]
    # trigrams of characters inside passages, white space as one mark
    spaced = np.where(kind == 0, 32, points).astype(np.uint32)
    tri = (spaced[:-2] * np.uint32(0x9E3779B1)) ^ (spaced[1:-1] * np.uint32(0x85EBCA6B)) ^ (spaced[2:] * np.uint32(0xC2B2AE35))
    bucket = ((tri ^ (tri >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(26)).astype(np.int64)
    middle = chars[(chars > 0) & (chars < len(points) - 1)]
    own = char_passage[(chars > 0) & (chars < len(points) - 1)]
    hist = np.bincount(own * TRIGRAM_BUCKETS + bucket[middle - 1], minlength=n * TRIGRAM_BUCKETS).reshape(n, TRIGRAM_BUCKETS)
    out[:, STATS:] = np.sqrt(hist / total[:, None])
    return out, bag


class AttentionModel:
    """x -> relu(x W + b) = h; a = softmax over the bag of w (tanh(h V) * sigmoid(h U)); score = sigmoid(c (sum a h) + d)."""

    def __init__(self, n_features: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": size(n_features, ENCODED), "b": np.zeros(ENCODED), "V": size(ENCODED, GATE), "U": size(ENCODED, GATE), "w": size(GATE), "c": size(ENCODED), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """``first``: where each bag begins; ``bag``: number of each passage's bag."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        logit = (t * s) @ p["w"]
        e = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -60, 60)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def gradients(self, f: dict[str, np.ndarray], bag: np.ndarray, first: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(target)
        dy = (f["y"] - target) / n
        dz = dy[:, None] * p["c"]
        dzp = dz[bag]
        da = (dzp * f["h"]).sum(axis=1)
        dl = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[bag])
        gate = dl[:, None] * p["w"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dzp + dt @ p["V"].T + ds @ p["U"].T
        dh[f["h"] <= 0] = 0
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dl, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}

    def fit(self, bags: list[np.ndarray], target: np.ndarray, seed: int = SEED) -> "AttentionModel":
        target = np.asarray(target, float)
        if len(target) == 0 or target.min() == target.max():
            self.constant = 0.5 if len(target) == 0 else float(target.mean())
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                sizes = np.array([len(bags[i]) for i in some])
                x, first, bag = np.concatenate([bags[i] for i in some]), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(some)), sizes)
                grads = self.gradients(self.forward(x, first, bag), bag, first, target[some])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, block, size = [], [], 0
        for i, t in enumerate(texts):
            block.append(t)
            size += len(t or "")
            if size > BLOCK_CHARS or i == len(texts) - 1:
                x, bag = features(block)
                first = np.searchsorted(bag, np.arange(len(block)))
                out.append(self.forward(x, first, bag)["y"])
                block, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, text, label) of a bounded sample of the labelled rows that may be learned from: crc32(doc_id) mod 5 is not 0."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (keyed_modulo("doc_id", 5) != 0)).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.crc32(F.concat(F.lit("sample"), F.col("_id").cast("string")).cast("binary")), "_id").limit(TRAIN_DOCUMENTS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> AttentionModel:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bags, classes = [], [], []
            for i, text, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x, _ = features([text])
                if len(x) <= TRAIN_PASSAGES:
                    ids.append(i)
                    bags.append(x.tobytes())
                    classes.append(c)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(bags, pa.binary()), pa.array(classes, pa.int32())], ["doc_id", "bag", "label"])

    got = labelled(docs, labels, label).mapInArrow(encode, "doc_id long, bag binary, label int").toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=lambda i: (got["doc_id"][i], got["bag"][i], got["label"][i]))
    width = STATS + TRIGRAM_BUCKETS
    bags = [np.frombuffer(got["bag"][i], np.float32).reshape(-1, width).astype(float) for i in order]
    return AttentionModel(width).fit(bags, np.array([got["label"][i] for i in order]))


def score_documents(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """(doc_id, score) of every row; the text is all that a score reads."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def build():
        own = shared.value

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), pa.array(own.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

        return apply

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, "doc_id long, score double", rows=2000)
