"""Quality rules: a ledger of failure bits and measurements, read by versioned policies."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.llm.common import materialize, read_table, small_batches, texts

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
WHITE = b" \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A document fails a rule where the condition over its measurements holds."""

    name: str
    bit: int
    condition: str

    @property
    def fails(self) -> Column:
        return F.expr(self.condition)


#: Bits keep their meaning for good; a rule that changes gets a new bit.
RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 25 * n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("shouting", 5, "100 * n_upper > 50 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A named set of rules that count."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[n] for n in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows whose word sequence the text holds twice or more."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((number[w] for text in words for w in text), np.int64, int(lengths.sum()))
    if len(ids) < window:
        return np.zeros(len(words), np.int64)
    doc = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    at = np.flatnonzero(np.arange(len(ids)) + window <= ends[doc])
    rng = np.random.default_rng(5).integers(1, 2**63, window + 1, dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        mix = (doc[at].astype(np.uint64) + np.uint64(1)) * rng[window]
        for k in range(window):
            mix = (mix ^ (mix >> np.uint64(29))) * rng[k] + ids[at + k].astype(np.uint64)
    order = np.argsort(mix, kind="stable")
    at, mix = at[order], mix[order]
    same = np.flatnonzero((mix[1:] == mix[:-1]) & (doc[at[1:]] == doc[at[:-1]]))
    for k in range(window):  # equal hashes are not taken on trust
        same = same[ids[at[same] + k] == ids[at[same + 1] + k]]
    hit = np.zeros(len(at), bool)
    hit[same] = hit[same + 1] = True
    edge = np.zeros(len(ids) + window + 1, np.int64)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + window, -1)
    covered = np.cumsum(edge)[: len(ids)] > 0
    return np.bincount(doc[covered], minlength=len(words))


def _measure(texts_: list[str]) -> list[np.ndarray | list[int]]:
    raw = [t.encode("utf-8") for t in texts_]
    words = [b.split() for b in raw]  # bytes split at ASCII white space
    lines = [t.split("\n") for t in texts_]
    dups = []
    for ls in lines:
        seen, n = set(), 0
        if len(set(ls)) < len(ls):
            for x in ls:
                if x in seen:
                    n += bool(x.encode("utf-8").split())
                seen.add(x)
        dups.append(n)
    return [
        [len(w) for w in words],
        [len(t) - (len(b) - len(b.translate(None, WHITE))) for t, b in zip(texts_, raw)],
        [sum(map(t.count, SYMBOLS)) for t in texts_],
        dups,
        repeated_words(words),
        [len(b) - len(b.translate(None, UPPER)) for b in raw],
        [len(ls) for ls in lines],
    ]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Evaluate every rule once: doc_id, the measurements and fail_bits, a row for each input row.

    A null or empty text has no words (and one empty line). Equal rows get equal
    results, a row without an id is measured like others, an empty table gives an
    empty ledger. Columns other than id and text are not read. Each text is judged
    by itself: no shuffle, and a task holds one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [pa.array(c, pa.int64()) for c in _measure(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *MEASURES])

    base = texts(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    measured = small_batches(base).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger_: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with kept (no rule of policy failed), policy and policy_version; texts are not read again."""
    return ledger_.withColumns({
        "kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0,
        "policy": F.lit(policy.name), "policy_version": F.lit(policy.version),
    })


def ablations(ledger_: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of policy: n_failed documents, n_regained if the rule alone is left out, n_kept without it.

    Documents are counted by their bits first, so at most one row for each set of
    failed rules goes further.
    """
    mask = policy.mask
    by_bits = ledger_.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in RULES if mask >> r.bit & 1]
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen))
    each = by_bits.select("bits", "n", F.inline(rules))
    failed, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(total(failed).alias("n_failed"), total(failed & (rest == 0)).alias("n_regained"), total(rest == 0).alias("n_kept"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(ledger(read_table(spark, sf_dir, "documents")), "ledger")  # policies come and go, rules are evaluated once
    judged = apply_policy(stored, STANDARD)
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(BASE.mask).cast("long")) != 0
    return judged.select("doc_id", *MEASURES[:5], base_failed.alias("base_failed"), "kept", "fail_bits", "n_upper", "n_lines")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
f AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
      FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM f WHERE gram IS NOT NULL),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM g WHERE n >= 2) GROUP BY rid),
l AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line) AS k
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
c AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE k > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]')) AS n FROM l GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             c.n::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, c.n_lines::BIGINT AS n_lines
      FROM w JOIN c USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
      + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
      + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
      + CASE WHEN 100 * n_upper > 50 * word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, n_upper, n_lines
FROM b
"""

QUERIES = {"op2_quality_ledger": op2_quality_ledger}
ORACLES = {"op2_quality_ledger": SQL}
