"""Line dedup: lines that several documents share stay in the first of them alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.llm.common import hash128, own_exchange, read_table, texts

#: ASCII white space, stripped at both ends of a line.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; other letters stay as they are."""
    key = F.btrim(line, F.lit(WHITE))
    # lower() maps letters of other scripts too, so it serves for ASCII lines only
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines whose key at least min_docs documents hold, except in the document with the smallest id.

    Returns a row for each input row: doc_id, text (lines that stay, joined by a
    line feed), n_lines (before dropping), n_dropped, and carried, a struct of the
    columns named in carry, if any.

    A null or empty text is one empty line. Keys shorter than min_chars code points
    never count. All rows of one id are one document: a line that only they hold is
    not shared. Equal rows get equal results. A row without an id is returned whole
    and its lines count for nothing. An empty table gives an empty result; columns
    other than id and text are not read.

    Only hashes of lines are shuffled for counting; texts move once, to meet the
    positions of their dropped lines. A hot line is one row for each document in the
    counts, summed before they are shuffled, and a splittable key in the join.
    """
    more = ["carried"] if carry else []
    base = texts(docs, id_col, text_col, carry).select("doc_id", F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("lines"), *more)
    keyed = (
        base.filter(F.col("doc_id").isNotNull())
        .select("doc_id", "version", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
    )
    one, two = hash128(F.col("key"))
    hashed = keyed.select("doc_id", "version", "pos", one.alias("h1"), two.alias("h2"))
    shared = (
        hashed.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    drops = (
        hashed.join(own_exchange(shared, "h1", "h2"), ["h1", "h2"])
        .filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drops"))
    )
    # positions without the dropped ones in one linear step; no search for each line
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    return base.join(drops, ["doc_id", "version"], "left").select(
        "doc_id", kept.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"), *more,
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS pos, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), s AS (
  SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), f AS (
  SELECT l.doc_id, l.pos, l.line, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone
  FROM l LEFT JOIN s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": SQL}
