"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, and only the bag has a label. Every passage is
encoded by a layer h = tanh(W x + b); a gated attention, w . (tanh(V h) * sigmoid(U h)),
gives each passage its weight within the document by softmax; the weighted sum of the
passage representations goes through a logistic unit. W, V, U, w and the unit are
learned together from the labels of documents, so the attention learns by itself which
passages a label is about: a page of junk between two clean paragraphs is enough.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.llm.common import read_table, sliced, texts
from sparseloom.llm.language import held_out
from sparseloom.llm.words import WordHashes

#: Words of a passage.
PASSAGE = 48
#: Bounds of the sample that the network is fitted to: labelled rows, and passages of one of them (evenly spaced). Scores read all passages.
SAMPLE_ROWS, SAMPLE_PASSAGES = 4000, 64
#: Sizes of the passage representation and of the attention; rounds over the sample.
HIDDEN, GATE, ROUNDS = 24, 12, 100
THRESHOLD = 0.7
#: Hashed parts of words: their first and last two bytes.
BUCKETS = 32
SHAPES = 22
FEATURES = SHAPES + 2 * BUCKETS
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>@^~_=+\\/{}[]"))
_UPPER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_LOWER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_STOPS = np.isin(np.arange(256), list(b".,;:!?"))
_HIGH = np.arange(256) >= 128
_LINE = np.arange(256) == 10
_CLASSES = (_SYMBOLS, _UPPER, _LOWER, _DIGIT, _STOPS, _HIGH)


def passages(texts_: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the number of passages of each text (1 at least: an empty text has an empty passage)."""
    raw = [t.encode("utf-8") for t in texts_]
    split = [b.split() for b in raw]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    counts = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    out = np.zeros((total, FEATURES), np.float32)
    words = [w for ws in split for w in ws]
    if not words:
        return out, counts
    doc = np.repeat(np.arange(len(split)), n_words)
    within = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    bag = first[doc] + within // PASSAGE
    size = np.fromiter(map(len, words), np.int64, len(words))
    joined = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(size) - size
    sums = np.stack([np.add.reduceat(c[joined].astype(np.int32), start) for c in _CLASSES], 1)
    h = hashes.of(words)
    n = np.bincount(bag, minlength=total).astype(np.float64)
    mean = lambda x: np.bincount(bag, x, total) / np.maximum(n, 1)
    chars = np.maximum(np.bincount(bag, size, total), 1)
    for j in range(len(_CLASSES)):
        out[:, j] = np.bincount(bag, sums[:, j], total) / chars
    upper, lower, last = sums[:, 1], sums[:, 2], joined[start + size - 1]
    out[:, 6] = mean((upper > 1) & (lower == 0))
    out[:, 7] = mean((upper > 0) & (lower > 0))
    out[:, 8] = mean(_SYMBOLS[last])
    out[:, 9] = mean(_STOPS[last])
    out[:, 10] = mean((sums[:, 1:4].sum(1) == 0) & (sums[:, 5] == 0))  # neither letters nor digits
    out[:, 11] = mean(size) / 10
    out[:, 12] = np.sqrt(np.maximum(mean(size.astype(float) ** 2) - mean(size) ** 2, 0)) / 10
    out[:, 13] = np.log1p(n) / 4
    for j, back in enumerate((1, 2, 3)):
        same = np.zeros(len(words), bool)
        same[back:] = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
        out[:, 14 + j] = mean(same)
    # words that the passage, and the document, has had before
    for j, group in ((17, bag), (18, doc)):
        order = np.lexsort((h, group))
        again = np.zeros(len(words), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        out[:, j] = mean(again)
    # five words in a row that the document has elsewhere
    with np.errstate(over="ignore"):
        run = h.copy()
        for k in range(1, 5):
            run[:-k] = run[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    full = within + 4 < n_words[doc]
    order = np.lexsort((run, doc, ~full))
    hit = np.zeros(len(words), bool)
    twin = (run[order[1:]] == run[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & full[order[1:]] & full[order[:-1]]
    hit[order[1:]] |= twin
    hit[order[:-1]] |= twin
    out[:, 19] = mean(hit)
    lines = np.fromiter((b.count(b"\n") for b in raw), np.int64, len(raw))
    out[:, 20] = np.repeat(lines / np.maximum(n_words, 1), counts)
    out[:, 21] = np.repeat(np.log1p(n_words) / 10, counts)
    head, tail = joined[start].astype(np.int64), last.astype(np.int64)
    second, before = joined[np.minimum(start + 1, start + size - 1)], joined[np.maximum(start + size - 2, start)]
    for j, x in enumerate((head * 256 + second, tail * 256 + before)):
        at = bag * BUCKETS + ((x * 40503) >> 7) % BUCKETS
        out[:, SHAPES + j * BUCKETS : SHAPES + (j + 1) * BUCKETS] = np.bincount(at, minlength=total * BUCKETS).reshape(total, BUCKETS) / np.maximum(n, 1)[:, None]
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Parameters, and the forward pass over bags that lie end to end."""

    def __init__(self, parameters: dict[str, np.ndarray], shift: np.ndarray, scale: np.ndarray):
        self.key, self.p, self.shift, self.scale = uuid.uuid4().hex, parameters, shift, scale

    def parts(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """What the pass makes: h of each passage, its attention a (sums to 1 within a document), z and score of each document."""
        p, first = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.shift) * self.scale, -8, 8)

    def attend(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each document and weight of each passage."""
        if not len(counts):
            return np.zeros(0), np.zeros(0)
        got = self.parts(self.normal(features), counts)
        return got["score"], got["a"]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss."""
        p, m = self.p, self.parts(x, counts)
        wide = lambda v: np.repeat(v, counts, axis=0)
        dz = ((m["score"] - y) / len(y))[:, None]
        gz = dz * p["c"]
        da = (m["h"] * wide(gz)).sum(1)
        mean = np.add.reduceat(m["a"] * da, np.cumsum(counts) - counts)
        de = m["a"] * (da - wide(mean))
        dt, dg = np.outer(de, p["w"]) * m["g"] * (1 - m["t"] ** 2), np.outer(de, p["w"]) * m["t"] * m["g"] * (1 - m["g"])
        dh = (wide(gz) * m["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - m["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": m["h"].T @ dt, "U": m["h"].T @ dg, "w": (m["t"] * m["g"]).T @ de, "c": m["z"].T @ dz[:, 0], "d": dz.sum()}


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Network:
    """Gated attention learned by Adam from the labels of bags. Without both labels the score is their share (1/2 without any)."""
    shift = features.mean(0) if len(features) else np.zeros(FEATURES)
    spread = features.std(0) if len(features) else np.zeros(FEATURES)
    rng = np.random.default_rng(seed)
    draw = lambda a, *b: rng.normal(0, 1 / np.sqrt(a), (a, *b))
    p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(())}
    net = Network(p, shift, 1 / np.maximum(spread, 0.02))
    if len(np.unique(labels)) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        p["c"], p["d"] = p["c"] * 0, np.log(share / (1 - share))
        return net
    x, first = net.normal(features), np.cumsum(counts) - counts
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(v) for k, v in p.items()}
    step, decay = 0, 1e-4
    for k in range(rounds):
        order, rate = rng.permutation(len(labels)), 0.01 * (1 - k / rounds)
        for part in np.array_split(order, max(1, len(order) // 256)):
            rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in part])
            g = net.gradients(x[rows], counts[part], labels[part])
            step += 1
            for n in p:
                g[n] = g[n] + decay * p[n]
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.99 * v[n] + 0.01 * g[n] ** 2
                p[n] = p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_passages: int = SAMPLE_PASSAGES) -> Network:
    """Fit the network to a sample of the labelled rows: at most sample_rows labels and as many rows with them, picked by hash, the same ones in every run.

    Labels are 0 or 1; rows with another or no label, or without an id, are left out.
    Of a document with more than sample_passages passages so many, evenly spaced, are
    fitted to. To the driver come features, at most sample_rows x sample_passages
    passages of them, never texts. Without labels the score is a constant.
    """
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    chosen = known.orderBy(F.xxhash64("doc_id", "y"), "doc_id", "y").limit(sample_rows)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # sample_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches):
            features, counts = passages(b.column(1).to_pylist(), hashes)
            parts = []
            for i, c in zip(np.cumsum(counts) - counts, counts):
                at = i + (np.arange(c) if c <= sample_passages else np.arange(sample_passages) * c // sample_passages)
                parts.append(features[at].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(parts, pa.binary())], ["doc_id", "y", "place", "features"])

    base = rows.select("doc_id", "text", "y", F.xxhash64("doc_id", "text").alias("place"))
    kind = base.schema["doc_id"].dataType.simpleString()
    found = base.mapInArrow(run, f"doc_id {kind}, y int, place long, features binary").orderBy("place", "y", "doc_id").limit(sample_rows).toArrow()
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in found.column("features").to_pylist()]
    counts = np.fromiter(map(len, bags), np.int64, len(bags))
    features = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return fit(features.astype(np.float64), counts, found.column("y").to_numpy().astype(np.float64))


_workers: dict[str, tuple[Network, WordHashes]] = {}


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), n_passages and focus, the number (from 0) of the passage with the largest weight: a row for each input row.

    All passages of the whole text count. A null or empty text has one empty passage
    and gets that one's score. Equal rows get equal results; no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)  # of a size that does not depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        if net.key not in _workers:
            _workers.clear()
            _workers[net.key] = net, WordHashes()
        hashes = _workers[net.key][1]
        for b in sliced(batches):
            features, counts = passages(b.column(1).to_pylist(), hashes)
            got, weight = net.attend(features, counts)
            first = np.cumsum(counts) - counts
            focus = [int(weight[i : i + c].argmax()) for i, c in zip(first, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(got, 6)), pa.array(counts), pa.array(focus, pa.int64())], ["doc_id", "score", "n_passages", "focus"])

    base = texts(docs, id_col, text_col)
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, n_passages long, focus long")


def op11_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    network = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return score(docs, network).select("doc_id", fold, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "focus")


QUERIES = {"op11_quality_attention": op11_quality_attention}
ORACLES: dict[str, str] = {}
