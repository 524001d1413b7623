"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word from their prefixes, and counts of a prefix bound the score of
all that grows from it: f(xyz) is at most f(xy) and at most f(yz), so a phrase xyz scores
at most 10^6 f(xy) / f(x) by its first cut and at most 10^6 f(yz) / f(z) by its last.
Of one word the bound is always 10^6 (the next word may follow each time), so the second
level is counted whole, between words that are frequent enough. Of the third level each
language counts, best first, what a bound lets reach its frontier, a score: that is
lowered until the language's last wanted surviving score lies at or above it. Then
everything that scores as much, ties included, has been counted exactly, and so have
all longer phrases by which phrases at or above the frontier are dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparseloom.llm.common import BitFilter, bit_filter, materialize, read_table, sliced

LEAST, TOP, UNIT = 10, 2000, 1_000_000
NO_LANGUAGE = "und"
#: Words that a task counts together before their sums go on; three numbers below twice as many fit into 63 bits.
FLUSH = 1_000_000
#: Ends pieces: a byte that no UTF-8 text has.
_END = b"\xff"
_TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEED = 42  # of Spark's xxhash64
_TURN = np.uint64(23)


def tokens(text: str) -> list[bytes]:
    """Words in lower case (A-Z), with an end mark where a piece ends."""
    return text.encode("utf-8").translate(_TABLE).replace(_END, b" \xff ").split()


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of two words in a row from those of the words; as _joined_column."""
    return x ^ ((y << _TURN) | (y >> np.uint64(41)))


def _word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def _joined_column(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(F.shiftleft(y, 23).bitwiseOR(F.shiftrightunsigned(y, 41)))


class Counter:
    """Words of one language, numbered as they come (0 ends a piece), for n-grams within pieces."""

    def __init__(self, lang: str):
        self.lang = lang
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[_END]
        self.parts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))

    def counted(self, n: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> pa.RecordBatch:
        """lang, phrase, n of the n-grams that are wanted, given the hashes of all words and the words of each place (n columns)."""
        ids = np.concatenate([*self.parts, np.zeros(1, np.int64)])
        grams = np.stack([ids[k : len(ids) - n + 1 + k] for k in range(n)], 1)
        grams = grams[(grams > 0).all(1)]
        words = list(self.number)
        if wanted is not None:
            seed = xxhash.xxh64_intdigest(self.lang.encode("utf-8"), _SEED)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
            grams = grams[wanted(hashes, grams)]
        key = grams[:, 0]
        for k in range(1, n):
            key = key * len(words) + grams[:, k]
        key, sums = np.unique(key, return_counts=True)
        known, columns = pa.array(words, pa.binary()), []
        for _ in range(n):
            columns.insert(0, known.take(pa.array(key % len(words))))
            key = key // len(words)
        phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if n > 1 else columns[0]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(sums), pa.string()), phrase.cast(pa.string()), pa.array(sums)], ["lang", "phrase", "n"])


def _ngrams(docs: DataFrame, n: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """lang, phrase, n: exact counts of the wanted n-grams of all texts, summed up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = 0, {}
        for b in sliced(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(text)
                if lang not in of:
                    of[lang] = Counter(lang)
                for at in range(0, len(words), FLUSH):  # n-grams that begin in one part of a very long text
                    of[lang].add(words[at : at + FLUSH + n - 1] + [_END])
                    held += min(FLUSH, len(words) - at)
                    if held >= FLUSH:
                        yield from (c.counted(n, wanted) for c in of.values())
                        held, of = 0, {lang: Counter(lang)}
        yield from (c.counted(n, wanted) for c in of.values())

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def score(a: Column, left: Column, right: Column, unit: int = UNIT) -> Column:
    """floor(unit * a * a / (left * right)), exact: products have up to 38 digits, so counts up to 10^15."""
    wide = lambda c: c.cast("decimal(16,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(unit).cast("decimal(7,0)")
    below = (wide(left) * wide(right)).cast("decimal(32,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), below.cast("decimal(38,0)")).cast("long")


def _sum_of(table: DataFrame, lang: str, phrase: str, name: str) -> DataFrame:
    return table.select(F.col("lang").alias(lang), F.col("phrase").alias(phrase), F.col("n").alias(name))


def _with_counts(df: DataFrame, table: DataFrame, part: Column, name: str) -> DataFrame:
    """df with the count of a part of its phrase."""
    return df.withColumn("part", part).join(_sum_of(table, "lang", "part", name), ["lang", "part"]).drop("part")


def _frontier(pairs: DataFrame, rank: int) -> DataFrame:
    """lang, tau: the score of the language's phrase of that rank, 0 if it has fewer. Scores are whole numbers up to 10^6, so a language has a bounded number of rows here."""
    sums = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("lang").orderBy(F.desc("score"))
    reached = sums.withColumn("sum", F.sum("n").over(run)).filter(F.col("sum") >= rank)
    return sums.select("lang").distinct().join(reached.groupBy("lang").agg(F.max("score").alias("tau")), "lang", "left").select("lang", F.coalesce("tau", F.lit(0)).alias("tau"))


def _wanted(frequent: BitFilter, prefix: BitFilter, suffix: BitFilter, open_: BitFilter) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def test(hashes: np.ndarray, grams: np.ndarray) -> np.ndarray:
        h = hashes[grams]
        xy, yz = _joined(h[:, 0], h[:, 1]), _joined(h[:, 1], h[:, 2])
        at = np.flatnonzero(frequent.passes(xy))
        at = at[frequent.passes(yz[at])]
        xy, yz = xy[at], yz[at]
        good = (prefix.passes(xy) & suffix.passes(yz)) | open_.passes(xy) | open_.passes(yz)
        out = np.zeros(len(grams), bool)
        out[at[good]] = True
        return out

    return test


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first top phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null language 'und'. Repeated rows count each time. Of equal
    scores the larger count comes first, then the smaller phrase by its bytes. A language
    without a phrase that occurs least times has no row; an empty table gives no row. Other
    columns are not read. What goes to all tasks are filters of at most 32 MB; what they let
    pass by chance is counted exactly too, so it does no harm.
    """
    base = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    everyone = materialize(_ngrams(base, 1), "words")
    totals = everyone.groupBy("lang").agg(F.sum("n").alias("total"))
    words = everyone.filter(F.col("n") >= least)
    known = bit_filter(words.select(_word_hash(F.col("lang"), F.col("phrase")).alias("h")), "h")

    def both_frequent(hashes: np.ndarray, grams: np.ndarray) -> np.ndarray:
        ok = known.passes(hashes)
        return ok[grams].all(1)

    x, y = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    pairs = _ngrams(base, 2, both_frequent).filter(F.col("n") >= least)
    pairs = _with_counts(_with_counts(pairs, words, x, "l"), words, y, "r")
    pairs = pairs.withColumns({"score": score(F.col("n"), F.col("l"), F.col("r")), "h": _joined_column(_word_hash(F.col("lang"), x), _word_hash(F.col("lang"), y))})
    pairs = materialize(pairs, "pairs")
    frequent = bit_filter(pairs.select("h"), "h")
    settled, rank, waiting, some = None, top, pairs, base
    while True:
        tau = materialize(_frontier(waiting, rank), "frontier")
        front = waiting.join(tau, "lang")
        begins = front.filter(F.floor(F.lit(UNIT) * F.col("n") / F.col("l")) >= F.col("tau"))
        ends = front.filter(F.floor(F.lit(UNIT) * F.col("n") / F.col("r")) >= F.col("tau"))
        opened = front.filter(F.col("score") >= F.col("tau"))
        wanted = _wanted(frequent, *(bit_filter(d.select("h"), "h") for d in (begins, ends, opened)))
        triples = _ngrams(some, 3, wanted).filter(F.col("n") >= least).join(tau, "lang")
        head, tail = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
        triples = _with_counts(_with_counts(triples, words, x, "l1"), pairs, tail, "r1")
        triples = _with_counts(_with_counts(triples, pairs, head, "l2"), words, y, "r2")
        first, last = score(F.col("n"), F.col("l1"), F.col("r1")), score(F.col("n"), F.col("l2"), F.col("r2"))
        triples = triples.withColumns({"s1": first, "s2": last}).withColumn("cut", F.when(F.col("s2") < F.col("s1"), 2).otherwise(1))
        of = lambda a, b: F.when(F.col("cut") == 1, F.col(a)).otherwise(F.col(b))
        triples = materialize(triples.select("lang", "phrase", "n", of("l1", "l2").alias("l"), of("r1", "r2").alias("r"), of("s1", "s2").alias("score"), "tau"), "triples")
        longer = triples.select("lang", "n", F.explode(F.array(head, tail)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
        two = opened.select("lang", "phrase", "n", "l", "r", "score", "tau").join(longer, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (F.lit(100) * F.col("longest") < F.lit(50) * F.col("n"))).drop("longest")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
        found = two.unionByName(triples.filter(F.col("score") >= F.col("tau"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        found = materialize(found, "phrases")
        done = found.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = tau.join(done, "lang", "left").filter((F.coalesce("found", F.lit(0)) < top) & (F.col("tau") > 0)).select("lang")
        state = materialize(state, "waiting")
        fresh = found.join(state, "lang", "left_anti")
        settled = fresh if settled is None else settled.unionByName(fresh)
        if state.isEmpty():
            break
        rank *= 4
        waiting, some = waiting.join(state, "lang", "left_semi"), base.join(state, "lang", "left_semi")
    kept = settled.join(totals, "lang")
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, row_number() OVER () AS pid, piece FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
w AS (SELECT lang, pid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
t AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY pid ORDER BY i)),
f1 AS (SELECT lang, x AS phrase, count(*) AS n FROM t GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS n FROM t WHERE y IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS n FROM t WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang),
c2 AS (SELECT f2.lang, f2.x, f2.y, x || ' ' || y AS phrase, f2.n AS a, u.n AS l, v.n AS r, (1000000::HUGEINT * f2.n * f2.n) // (u.n::HUGEINT * v.n) AS score
       FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.phrase = f2.x JOIN f1 v ON v.lang = f2.lang AND v.phrase = f2.y WHERE f2.n >= 10),
c3 AS (SELECT f3.lang, f3.x, f3.y, f3.z, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.n AS a, u.n AS l1, q.n AS r1, o.n AS l2, v.n AS r2,
              (1000000::HUGEINT * f3.n * f3.n) // (u.n::HUGEINT * q.n) AS s1, (1000000::HUGEINT * f3.n * f3.n) // (o.n::HUGEINT * v.n) AS s2
       FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.phrase = f3.x JOIN f1 v ON v.lang = f3.lang AND v.phrase = f3.z
       JOIN f2 o ON o.lang = f3.lang AND o.x = f3.x AND o.y = f3.y JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z),
inside AS (SELECT lang, x, y, max(a) AS longest FROM (SELECT lang, x, y, a FROM c3 UNION ALL SELECT lang, y, z, a FROM c3) GROUP BY ALL),
kept AS (SELECT c2.lang, phrase, a, l, r, score FROM c2 LEFT JOIN inside i ON i.lang = c2.lang AND i.x = c2.x AND i.y = c2.y WHERE coalesce(100 * longest < 50 * a, TRUE)
         UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM c3)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score::BIGINT AS score
FROM kept k JOIN total ON total.lang = k.lang
QUALIFY rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": SQL}
