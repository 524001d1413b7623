"""Language identification by prediction by partial matching over bytes.

For each language a context tree of variable order holds how often each byte
followed each context of up to ORDER bytes. A text's code length under a tree is
the sum over its bytes of -log2 p, where p comes from the longest context seen in
training: a byte seen there gets n / (total + distinct), another one the escape
distinct / (total + distinct) times its probability in the next shorter context,
bytes of the longer context excluded. The statistics are frozen, so p depends on
the last ORDER + 1 bytes alone. The language of the shortest code wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparseloom.llm.common import materialize, read_table, sliced, small_batches, texts

ORDER = 4
#: Bounds of the labelled sample that the trees are grown from, picked by hash: rows of a language, and rows of all languages together. Of the picked rows every gram counts.
SAMPLE_TEXTS, SAMPLE_ROWS = 300, 30_000
NO_LANGUAGE = "und"
_PAD = b" " * ORDER
#: Slots of the table of grams times languages, as a power of two.
_TABLE_BITS = 22


def _grams(data: bytes, n: int) -> np.ndarray:
    """For each byte after the padding: it and the n - 1 bytes before it, as one number."""
    b = np.frombuffer(data, np.uint8)
    key = np.zeros(len(b) - ORDER, np.uint64)
    for back in range(n - 1, -1, -1):
        key = (key << np.uint64(8)) | b[ORDER - back : len(b) - back].astype(np.uint64)
    return key


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of ORDER + 1 bytes of texts, letters in lower case, and how often they occur."""
    keys = [_grams(_PAD + t.lower(), ORDER + 1) for t in texts]
    return np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_counts=True)


class Tree:
    """Counts of one language, by order: sorted contexts with their sums, sorted context-and-byte keys with counts. Grown from counts of the longest grams, of which shorter ones are sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.grams, self.counts, self.contexts, self.total, self.distinct, self.shadow = [], [], [], [], [], []
        for k in range(ORDER + 1):
            gram, back = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.zeros(len(gram), np.int64)
            np.add.at(count, back, counts)
            context, first = np.unique(gram >> np.uint64(8), return_index=True)
            spans = lambda x: np.add.reduceat(x, first) if len(first) else x  # noqa: B023, E731
            self.grams.append(gram), self.counts.append(count), self.contexts.append(context)
            self.total.append(spans(self.counts[k])), self.distinct.append(spans(np.ones(len(gram), np.int64)))
            if k:  # how often the bytes of a context follow the next shorter one
                shorter = np.searchsorted(self.grams[k - 1], gram & np.uint64((1 << 8 * k) - 1))
                self.shadow.append(spans(self.counts[k - 1][shorter]) if len(gram) else count)
            else:
                self.shadow.append(np.zeros(len(context), np.int64))

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each key after the ORDER bytes before it."""
        bits = np.zeros(len(keys))
        todo = np.arange(len(keys))
        less_total, less_distinct = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k in range(ORDER, -1, -1):
            key = keys[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, seen = _find(self.contexts[k], key >> np.uint64(8))
            total = np.where(seen, self.total[k][at] if len(self.total[k]) else 0, 0) - less_total[todo]
            distinct = np.where(seen, self.distinct[k][at] if len(self.distinct[k]) else 0, 0) - less_distinct[todo]
            usable = seen & (distinct > 0)
            gram, known = _find(self.grams[k], key)
            hit = usable & known
            bits[todo[hit]] += np.log2((total + distinct)[hit]) - np.log2(self.counts[k][gram[hit]])
            escape = usable & ~known
            bits[todo[escape]] += np.log2((total + distinct)[escape]) - np.log2(distinct[escape])
            if k and len(self.shadow[k]):
                less_total[todo[seen]] = self.shadow[k][at[seen]]
                less_distinct[todo[seen]] = self.distinct[k][at[seen]]
            if not k:
                less_distinct[todo[seen]] = self.distinct[0][at[seen]]
            todo = todo[~hit]
        bits[todo] += np.log2(np.maximum(256 - less_distinct[todo], 1))
        return bits


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


class Scorer:
    """Code lengths of whole texts under all trees. Grams of ORDER + 1 bytes met before are looked up in a table of fixed size."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        bits = max(10, _TABLE_BITS - len(trees).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key = np.full(1 << bits, np.uint64(2**64 - 1))
        self.bits = np.zeros((1 << bits, len(trees)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def batch(self, texts: list[str]) -> np.ndarray:
        raw = [_PAD + t.encode("utf-8").lower() for t in texts]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        keys = _grams(_PAD + b"".join(raw), ORDER + 1)
        inside = np.ones(len(keys), bool)
        starts = np.cumsum(lengths) - lengths
        for i in range(ORDER):
            inside[starts + i] = False
        keys = keys[inside]
        slot = self._slot(keys)
        new = self.key[slot] != keys
        bits = self.bits[slot]
        if new.any():
            fresh, back = np.unique(keys[new], return_inverse=True)
            found = np.stack([t.code_lengths(fresh) for t in self.trees], 1)
            bits[new] = found[back]
            where = self._slot(fresh)
            self.key[where], self.bits[where] = fresh, found  # of grams that share a slot the last stays
        doc = np.repeat(np.arange(len(texts)), lengths - ORDER)
        return np.stack([np.bincount(doc, bits[:, j], len(texts)) for j in range(len(self.trees))], 1)


class Model:
    """Trees of the learned languages, in the order of their names."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.key = uuid.uuid4().hex
        self.languages = sorted(counts)
        self.trees = [Tree(*counts[n]) for n in self.languages]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trees from about sample_texts texts of each language, picked by a hash of id and text, the same ones in every run.

    Rows without text or language are left out; every other language is learned. With so
    many languages that these would be more than about sample_rows rows, each has its part
    of them. Grams are counted where the texts are; to the driver come counts of all grams
    of the picked rows. The share of texts is set from the exact number of rows of each language.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    numbers = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = (F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    numbers = materialize(numbers, "languages")
    known = numbers.count()
    few = F.broadcast(numbers) if known <= sample_rows else numbers
    picked = rows.join(few, "lang").filter(place < F.lit(min(float(sample_texts), sample_rows / max(1, known))) / F.col("n")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of.setdefault(lang, []).append(text.encode("utf-8"))
            for lang, texts_ in of.items():
                keys, n = gram_counts(texts_)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    sums = small_batches(picked).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sums.toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    names, gram, n = found.column("lang").to_pandas().to_numpy(), found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    counts = {lang: (gram[names == lang], n[names == lang]) for lang in dict.fromkeys(names.tolist())}
    for r in numbers.select("lang").toLocalIterator():  # a language of nothing but empty texts
        counts.setdefault(r["lang"], (gram[:0], n[:0]))
    return Model(counts)


_workers: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The language of each whole text: doc_id, lang_pred, score, a row for each input row; and carried, a struct of the columns in carry, if any.

    score is the share of the winner if each language's code length is taken for its
    likelihood. A text that is null or has no letter is 'und' with score 0, and so is
    every text if no language was learned. Of equal code lengths the first language
    by name wins. Equal rows get equal results; no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        if m.key not in _workers:
            _workers.clear()
            _workers[m.key] = Scorer(m.trees)
        scorer = _workers[m.key]
        for b in sliced(batches, size=1 << 20):  # a gram of a text takes some forty bytes while it is scored
            got = b.column(1).to_pylist()
            use = [i for i, t in enumerate(got) if t and m.languages and any(map(str.isalpha, t))]
            pred, score = [NO_LANGUAGE] * len(got), [0.0] * len(got)
            if use:
                bits = scorer.batch([got[i] for i in use])
                best = bits.argmin(1)
                share = 1 / np.exp2(np.minimum(bits.min(1)[:, None] - bits, 0)).sum(1)
                for i, j, s in zip(use, best, share):
                    pred[i], score[i] = m.languages[j], float(min(1.0, s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *b.columns[2:]], ["doc_id", "lang_pred", "score", *more])

    more = ["carried"] if carry else []
    base = texts(docs, id_col, text_col, carry)
    schema = T.StructType([base.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(base.schema[c] for c in more)])
    return small_batches(base).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
