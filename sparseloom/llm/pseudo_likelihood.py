"""Language-model scores: masked pseudo-likelihood under a small bidirectional window network.

The network sees the embeddings of the SIDE words on the left and on the right of a
place, not the word itself, and gives the probability of each class of words there.
A document's score is the sum of the conditional log-probabilities of its words,
log P(class | both sides) + log P(word | class).

Classes are the most frequent words of the whole corpus, by exact counts, and
buckets that share the others out by hash; there are the more of both the more words
the corpus has. Within a bucket a word has its share of the bucket's count, UNSEEN of
which is set aside for words that the corpus doesn't have.

The network starts from exact counts of neighbouring classes over all texts: their
singular vectors are the first embeddings and output weights. Then it is trained on
all texts in ROUNDS rounds, each on the texts that a hash of the text puts there; a
round is one step along the gradient summed over its texts. Gradients of a text are
rounded to a grid before they are summed, so sums, parameters and scores are the same
however the table is partitioned.

Counts of all words stay a table. Every worker has those of words with a share of
1/SHARE or more, so there are at most SHARE of them and no other word is hot; places of
other words go to the part of the table that holds their counts, many in a row, and
sums by document come back. There, words of one 63-bit hash are taken for equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.llm.common import materialize, read_table, shared_path, small_batches, texts
from sparseloom.storage import remove_at_end

#: Words with a class of their own, buckets of the other words, both at least; one more value stands for the ends of a text.
TOP, BUCKETS = 48, 16
CLASSES = TOP + BUCKETS
#: Words on each side, values of an embedding, hidden units.
SIDE, WIDTH = 2, 8
HIDDEN = 2 * SIDE * WIDTH
#: Places of a text that are taken together; rounds and rate of training; parts of 1 that gradients are rounded to.
BATCH, ROUNDS, RATE, GRID = 2048, 12, 0.005, float(1 << 20)
#: Of the counts of neighbours: weight of the frequencies they are smoothed by, share of each side's evidence that counts.
SMOOTH, SHARE_OF_SIDE = 5.0, 0.6
#: Words that a task counts at once before it hands the counts on.
COUNTED = 1_000_000
#: Words that make up 1/SHARE of all or more are known to every worker. Places of other words that one part of their counts meets, about.
SHARE, PLACES = 200_000, 1_000_000
#: Of the count of a bucket, for all words that the corpus doesn't have.
UNSEEN = 0.5
_BITS63 = (1 << 63) - 1
_SIDES, _AROUND = np.arange(2 * SIDE), np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def class_sizes(total: int) -> tuple[int, int]:
    """Words with a class of their own and buckets, for a corpus of total words."""
    root = int(total**0.25)
    return max(TOP, root), max(BUCKETS, root // 3)


def code(word: bytes) -> int:
    """63 bits that stand for a word; Spark's xxhash64 has the same."""
    return xxhash.xxh64_intdigest(word, 42) & _BITS63


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).astype(np.int64) & _BITS63


def _code() -> Column:
    return F.xxhash64("word").bitwiseAND(F.lit(_BITS63))


def _shapes(classes: int) -> tuple[tuple[int, ...], ...]:
    return (2 * SIDE, classes + 1, WIDTH), (HIDDEN, HIDDEN), (HIDDEN,), (HIDDEN, classes), (classes,)


def _words(batch: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, maximal runs of bytes other than ASCII white space, and how many each text has."""
    lists = pc.ascii_split_whitespace(batch)
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end of a text leaves an empty part
    return flat.filter(some), np.bincount(of.filter(some).to_numpy(), minlength=len(batch))


def _numbered(lookup: Classes | Codes, batch: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words, and how many words each text has. A word is looked up once in a batch."""
    flat, n = _words(pa.array(batch, pa.string()))
    coded = flat.dictionary_encode()
    return lookup.values(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy()], n


def _padded(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words with SIDE end marks around each text, and places of the words."""
    starts = np.cumsum(n + 2 * SIDE) - n - SIDE
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(ids))
    padded = np.full(len(ids) + 2 * SIDE * len(n), end, np.int64)
    padded[at] = ids
    return padded, at


def _alone(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """As _padded, for one text."""
    padded = np.full(len(ids) + 2 * SIDE, end, np.int64)
    padded[SIDE : SIDE + len(ids)] = ids
    return padded, np.arange(SIDE, SIDE + len(ids))


class Classes:
    """Classes of words (bytes)."""

    def __init__(self, top: list[bytes], tops: int = TOP, buckets: int = BUCKETS):
        self.top, self.tops, self.buckets = {w: i for i, w in enumerate(top)}, tops, buckets

    def __getitem__(self, word: bytes) -> int:
        return int(self.values([word])[0])

    def values(self, words: list[bytes]) -> np.ndarray:
        own = np.fromiter(map(self.top.get, words, repeat(-1)), np.int64, len(words))
        return np.where(own < 0, self.tops + codes_of(words) % self.buckets, own)

    def of(self, batch: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all words with SIDE end marks around each text, places of the words, and how many each text has."""
        ids, n = _numbered(self, batch)
        return *_padded(ids, n, self.tops + self.buckets), n


def start_values(frequencies: np.ndarray, neighbours: list[np.ndarray]) -> np.ndarray:
    """Parameters from counts: of classes, and for each distance of pairs (first, second) of classes, ends of texts being the last one."""
    classes = len(frequencies)
    prob = (frequencies + 1) / (frequencies + 1).sum()
    embedding, out = np.zeros((2 * SIDE, classes + 1, WIDTH)), np.zeros((HIDDEN, classes))
    for side, back in enumerate([*range(SIDE, 0, -1), *range(-1, -SIDE - 1, -1)]):
        n = (neighbours[back - 1] if back > 0 else neighbours[-back - 1].T)[:, :classes]
        told = np.log((n + SMOOTH * prob) / (n.sum(1, keepdims=True) + SMOOTH) / prob)
        u, s, v = np.linalg.svd(told * np.sqrt(prob), full_matrices=False)
        root = np.sqrt(s[:WIDTH])
        embedding[side] = u[:, :WIDTH] * root
        out[side * WIDTH : (side + 1) * WIDTH] = v[:WIDTH] * root[:, None] / np.sqrt(prob) * SHARE_OF_SIDE
    scale = max(1e-6, 1.5 * np.abs(embedding).max())  # hidden units start where they are all but linear
    return np.concatenate([(embedding / scale).ravel(), np.eye(HIDDEN).ravel(), np.zeros(HIDDEN), (out * scale).ravel(), np.log(prob)])


class Network:
    def __init__(self, values: np.ndarray):
        # their number is a linear function of that of the classes
        none, one = (sum(int(np.prod(s)) for s in _shapes(c)) for c in (0, 1))
        self.classes = (len(values) - none) // (one - none)
        shapes = _shapes(self.classes)
        sizes = np.cumsum([int(np.prod(s)) for s in shapes])
        self.values = values.astype(np.float32)
        self.parts = [p.reshape(s) for p, s in zip(np.split(self.values, sizes[:-1]), shapes)]
        self.out = self.values[sizes[-3] :].reshape(HIDDEN + 1, self.classes)  # weights and bias lie one after the other
        self.embeddings = self.parts[0].reshape(-1, WIDTH)  # a row for each side and class
        self.cells = np.arange(self.embeddings.size).reshape(-1, WIDTH)
        self.ones = np.ones(self.classes, np.float32)

    def logits(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the embeddings around each place, these, hidden units and logits."""
        _, w1, b1, _, _ = self.parts
        around = padded.take(at[:, None] + _AROUND)
        around += _SIDES * (self.classes + 1)
        x = self.embeddings.take(around, axis=0).reshape(len(at), -1)
        h = np.ones((len(at), HIDDEN + 1), np.float32)  # the last unit is for the bias
        inner = x @ w1
        inner += b1
        np.tanh(inner, out=h[:, :HIDDEN])
        z = h @ self.out
        if not z.size or z.max() > 60:
            np.minimum(z, 60, out=z)  # no overflow; such a logit is as good as certain
        return around, x, h, z

    def forward(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        around, x, h, z = self.logits(padded, at)
        np.exp(z, out=z)
        z *= (1 / (z @ self.ones))[:, None]
        return around, x, h, z

    def gradient(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the summed negative log-probability of the classes at these places, for all parameters."""
        around, x, units, p = self.forward(padded, at)
        _, w1, _, w2, _ = self.parts
        h = units[:, :HIDDEN]
        p[np.arange(len(at)), padded[at]] -= 1
        back = p @ w2.T
        back *= 1 - h * h
        de = np.bincount(self.cells.take(around, axis=0).ravel(), (back @ w1.T).ravel(), self.cells.size)
        return np.concatenate([de, (x.T @ back).ravel(), back.sum(0), (p.T @ units).T.ravel()])

    def text_gradient(self, ids: np.ndarray) -> np.ndarray:
        """The gradient of a text, piece by piece on the grid: whole numbers."""
        padded, at = _alone(ids, self.classes)
        total = np.zeros(len(self.values))
        for k in range(0, len(at), BATCH):
            piece = self.gradient(padded, at[k : k + BATCH])
            piece *= GRID
            np.rint(piece, out=piece)
            total = piece if k == 0 else total + piece
        return total

    def log_prob(self, ids: np.ndarray) -> float:
        """Summed log-probability of the classes of a text. A text is never computed together with others, so equal ones score the same."""
        padded, at = _alone(ids, self.classes)
        total = 0.0
        for k in range(0, len(at), BATCH):
            part = at[k : k + BATCH]
            z = self.logits(padded, part)[3]
            own = z[np.arange(len(part)), padded[part]]
            total += float((own - np.log(np.exp(z, out=z) @ self.ones)).sum(dtype=np.float64))
        return total


@dataclass
class Vocabulary:
    """What every worker knows of the words: top have a class of their own; head has counts of hot words, in_bucket those of buckets."""

    top: list[bytes]
    tops: int
    buckets: int
    head: dict[bytes, int]
    in_bucket: np.ndarray
    parts: int


@dataclass
class Model:
    vocabulary: Vocabulary
    values: np.ndarray
    counts: DataFrame
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def top(self) -> list[bytes]:
        return self.vocabulary.top


class Codes:
    """Codes of words (bytes), or ~i of the word i of the head."""

    def __init__(self, v: Vocabulary):
        self.v, self.rank, classes = v, {w: ~i for i, w in enumerate(v.head)}, Classes(v.top, v.tops, v.buckets)
        self.head_class = classes.values(list(v.head))
        own = self.head_class < v.tops
        self.head_log = np.where(own, 0, np.log(np.fromiter(v.head.values(), float, len(v.head))))
        self.class_log = np.concatenate([np.zeros(v.tops), np.log(v.in_bucket + UNSEEN)])

    def values(self, words: list[bytes]) -> np.ndarray:
        rank = np.fromiter(map(self.rank.get, words, repeat(0)), np.int64, len(words))
        return np.where(rank < 0, rank, codes_of(words))

    def of(self, batch: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes and classes of all words, log P(word | class) as far as it is known here, and how many words each text has.

        What a word outside the head lacks is the logarithm of its count.
        """
        codes, n = _numbered(self, batch)
        classes, lacks = self.v.tops + codes % self.v.buckets, np.zeros(len(codes))
        known = np.flatnonzero(codes < 0)
        rank = ~codes[known]
        classes[known], lacks[known] = self.head_class[rank], self.head_log[rank]
        return codes, classes, lacks - self.class_log[classes], n


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and n over all texts; each task hands on sums, not words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            counted = pa.chunked_array(held, pa.string()).value_counts()
            return pa.RecordBatch.from_arrays([counted.field("values").cast(pa.binary()), counted.field("counts")], ["word", "n"])

        for b in batches:
            held.append(_words(pa.array(b.column(0), pa.string()))[0])
            if sum(map(len, held)) > COUNTED:
                yield out()
                held.clear()
        yield out()

    return small_batches(docs.select("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Count the words of all texts and train on all of them; None if there is no word.

    To the driver come words with a class of their own, the at most SHARE hot ones,
    counts of pairs of classes, and in each round one sum for each parameter. Frequent
    words of equal counts are ranked by their bytes.
    """
    base = texts(docs, id_col, text_col)
    counts = materialize(word_counts(base), "words")
    words = counts.agg(F.sum("n")).first()[0]
    if not words:
        return None
    tops, buckets = class_sizes(words)
    own = {bytes(r["word"]): r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(tops).collect()}
    top = list(own)
    head = own | {bytes(r["word"]): r["n"] for r in counts.filter(F.col("n") * SHARE >= words).collect()}
    in_bucket = np.zeros(buckets)
    for r in counts.groupBy(F.pmod(_code(), F.lit(buckets)).alias("b")).agg(F.sum("n").alias("n")).collect():
        in_bucket[r["b"]] = r["n"]
    for w, n in own.items():
        in_bucket[code(w) % buckets] -= n
    parts = max(16, (words - sum(head.values())) // PLACES)

    encoded = _encoded(base, top, tops, buckets)
    frequencies = np.concatenate([np.array([own[w] for w in top] + [0] * (tops - len(top)), float), in_bucket])
    values = start_values(frequencies, _neighbours(encoded, tops + buckets))
    seen = np.zeros(len(values))
    for r in range(ROUNDS):
        n, gradient = _round(encoded.filter(F.col("slice") == r), values)
        if n:
            gradient /= GRID * n
            seen += gradient * gradient
            values = values - RATE * gradient / np.sqrt(seen + 1e-10)
    return Model(Vocabulary(top, tops, buckets, head, in_bucket, parts), values, counts)


def _encoded(base: DataFrame, top: list[bytes], tops: int, buckets: int) -> DataFrame:
    """classes (of the words of a text, 2 bytes each) and slice (the round that trains on it), kept in the shared folder by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(top, tops, buckets)
        for b in batches:
            ids, n = _numbered(classes, b.column(0))
            ends = np.cumsum(n)
            ids = ids.astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([ids[j - k : j].tobytes() for j, k in zip(ends, n)], pa.binary())], ["slice", "classes"])

    spark, path = base.sparkSession, shared_path(base.sparkSession, "classes")
    rows = base.select("text", F.pmod(F.xxhash64("text"), F.lit(ROUNDS)).cast("int").alias("slice"))
    small_batches(rows).mapInArrow(run, "slice int, classes binary").write.partitionBy("slice").parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema("classes binary, slice int").parquet(path)


def _class_lists(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), np.uint16).astype(np.int64) for c in b.column(0)]


def _neighbours(encoded: DataFrame, classes: int) -> list[np.ndarray]:
    """For each distance up to SIDE, how often a class follows a class, over all texts. To the driver come at most SIDE times the square of the number of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((SIDE, (classes + 1) ** 2), np.int64)
        for b in batches:
            lists = _class_lists(b)
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            padded, _ = _padded(np.concatenate([*lists, np.zeros(0, np.int64)]), n, classes)
            for d in range(1, SIDE + 1):
                sums[d - 1] += np.bincount(padded[:-d] * (classes + 1) + padded[d:], minlength=(classes + 1) ** 2)
        d, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(cell), pa.array(sums[d, cell])], ["d", "cell", "n"])

    rows = small_batches(encoded.select("classes")).mapInArrow(run, "d int, cell long, n long").groupBy("d", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((SIDE, (classes + 1) ** 2))
    out[rows.column("d").to_numpy(), rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    out[:, -1] = 0  # an end after an end says nothing
    return list(out.reshape(SIDE, classes + 1, classes + 1))


def _round(encoded: DataFrame, values: np.ndarray) -> tuple[int, np.ndarray]:
    """Words of these texts, and the gradient summed over them, in parts of GRID."""
    sent = encoded.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, n = Network(sent.value), 0
        total = np.zeros(len(net.values))  # whole numbers: sums are exact
        for b in batches:
            for ids in _class_lists(b):
                if len(ids):
                    total += net.text_gradient(ids)
                    n += len(ids)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(n, total).astype(np.int64))], ["i", "g"])

    rows = small_batches(encoded.select("classes")).mapInArrow(run, "i long, g long").groupBy("i").agg(F.sum("g").alias("g")).toArrow()
    sums = np.zeros(len(values) + 1)
    sums[rows.column("i").to_numpy() + 1] = rows.column("g").to_numpy()
    sent.unpersist()
    return int(sums[0]), sums[1:]


_workers: dict[str, tuple[Network, Codes]] = {}


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the counts with a code; bits other than those that choose a bucket."""
    return ((codes >> 20) % parts).astype(np.uint16 if parts <= 1 << 16 else np.int64)


def _first(values: pa.Array, more: int) -> pa.Array:
    """All values in a first row, and null in more rows."""
    one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.concat_arrays([one, pa.nulls(more, one.type)])


def _counted(places: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums of log n by batch and document, for the places of one part; rows of whole batches pass."""
    words = counts.column("code").to_numpy()
    order = np.argsort(words)
    words, logs = words[order], np.append(np.log(counts.column("n").to_numpy()[order]), np.log(UNSEEN))
    whole = pc.is_null(places.column("codes"))
    sent = places.filter(pc.invert(whole))
    docs, sums = [], []
    for codes, of in zip(sent.column("codes"), sent.column("docs")):
        codes, of = np.frombuffer(codes.as_buffer(), np.int64), np.frombuffer(of.as_buffer(), np.uint16)
        at = np.searchsorted(words, codes)
        found = at < len(words)
        found[found] = words[at[found]] == codes[found]
        s = np.bincount(of, logs[np.where(found, at, len(words))])
        some = np.flatnonzero(s)
        docs.append(some.astype(np.uint16).tobytes())
        sums.append(s[some].tobytes())
    sent = sent.set_column(sent.column_names.index("docs"), "docs", pa.array(docs, pa.binary()))
    sent = sent.set_column(sent.column_names.index("codes"), "codes", pa.array(sums, pa.binary()))
    return pa.concat_tables([t.cast(places.schema) for t in (places.filter(whole), sent)]).rename_columns({"codes": "sums"})


def _summed(rows: pa.Table) -> pa.Table:
    """Scores of the documents of a batch. Sums are added in the order of parts, so equal texts get equal ones."""
    rows = rows.sort_by("part")
    whole = pc.is_null(rows.column("sums"))
    batch, rows = rows.filter(whole), rows.filter(pc.invert(whole))
    ids, n, total = (batch.column(c).combine_chunks().flatten() for c in ("ids", "n", "total"))
    n, total = n.to_numpy(), total.to_numpy().copy()
    for docs, sums in zip(rows.column("docs"), rows.column("sums")):
        total[np.frombuffer(docs.as_buffer(), np.uint16)] += np.frombuffer(sums.as_buffer(), np.float64)
    mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0), pa.float64(), mask=n == 0)
    return pa.table([ids, pa.array(n, pa.int64()), pa.array(total, pa.float64()), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all words), mean_log_prob (null without words), a row for each input row.

    A null or empty text has no words and log_prob 0. Equal rows get equal scores;
    rows without an id are scored like others. All words that the model's corpus doesn't
    have share UNSEEN of the count of their bucket. Without a model nothing had a word.
    """
    base = texts(docs, id_col, text_col)
    if not model:
        return base.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_prob"), F.lit(None).cast("double").alias("mean_log_prob"))
    v = model.vocabulary
    sent = docs.sparkSession.sparkContext.broadcast((model.key, v, model.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, v, values = sent.value
        if key not in _workers:
            _workers.clear()
            _workers[key] = Network(values), Codes(v)
        net, lookup = _workers[key]
        first = TaskContext.get().partitionId() << 32
        for batch, b in enumerate(batches, first):
            codes, classes, within, n = lookup.of(b.column(1))
            of = np.repeat(np.arange(len(n)), n)
            ends = np.cumsum(n)
            total = np.bincount(of, within, len(n)) + [net.log_prob(classes[j - k : j]) if k else 0.0 for j, k in zip(ends, n)]
            far = np.flatnonzero(codes >= 0)
            part = _part(codes[far], v.parts)
            order = np.argsort(part, kind="stable")
            codes, of, part = codes[far][order], of[far][order].astype(np.uint16), part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            starts, ends = (np.concatenate(c).astype(np.int64) for c in ([[0], cuts], [cuts, [len(part)]]))
            if not len(part):
                starts = ends = starts[:0]
            m = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch % v.parts, *part[starts].tolist()], pa.int32()),
                    pa.array([batch] * (m + 1), pa.int64()),
                    *(_first(a, m) for a in (b.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()))),
                    pa.array([None, *(codes[i:j].tobytes() for i, j in zip(starts, ends))], pa.binary()),
                    pa.array([None, *(of[i:j].tobytes() for i, j in zip(starts, ends))], pa.binary()),
                ],
                ["part", "batch", "ids", "n", "total", "codes", "docs"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    row = f"part int, batch long, ids array<{kind}>, n array<long>, total array<double>, %s binary, docs binary"
    places = small_batches(base).mapInArrow(run, row % "codes")
    counts = model.counts.select(_code().alias("code"), "n")
    counts = counts.select("code", "n", F.pmod(F.shiftright("code", 20), F.lit(v.parts)).cast("int").alias("part"))
    met = places.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_counted, row % "sums")
    return met.groupBy("batch").applyInArrow(_summed, f"doc_id {kind}, n_tokens long, log_prob double, mean_log_prob double")


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs))


QUERIES = {"op10_pseudo_likelihood": op10_pseudo_likelihood}
ORACLES: dict[str, str] = {}
