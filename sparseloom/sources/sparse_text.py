"""libsvm and libffm text as tables of samples, and back.

A sample is (seq, y, x): seq orders the lines, y is 0 or 1, x an array of (field,
feat, value). Order and repetitions of entries are kept; entries of value 0 are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparseloom.functions.expressions import tokens
from sparseloom.storage import materialize

ENTRY = "struct<field: int, feat: int, value: float>"
#: Numbers are read as far as they go, so '1.0' is the whole number 1.
_WHOLE, _REAL = r"^([+-]?\d+)", r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
#: Lines of plain short numbers with single spaces: most lines are, and need no pattern for each number. Possessive, so long lines take no stack.
_PLAIN = r"^\d{1,9}(?: %s\d{1,9}:[+-]?\d{1,9}(?:\.\d{1,9})?)*+$"
MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")


def _whole(t: Column) -> Column:
    return F.regexp_extract(t, _WHOLE, 1).try_cast("int")


def _real(t: Column) -> Column:
    return F.regexp_extract(t, _REAL, 1).try_cast("float")


def token_format(token: Column) -> Column:
    """libsvm for one colon, libffm for two, else null."""
    colons = F.length(token) - F.length(F.replace(token, F.lit(":")))
    return F.when(colons == 1, "libsvm").when(colons == 2, "libffm")


def line_formats(lines: DataFrame) -> DataFrame:
    """How many lines are of which format, by their first entry: file_type, n_lines."""
    first = F.try_element_at(tokens(F.col("value")), F.lit(2))
    return lines.select(token_format(first).alias("file_type")).groupBy("file_type").agg(F.count(F.lit(1)).alias("n_lines"))


def detect_format(spark: SparkSession, path: str) -> str:
    """The format of a file by its first line; a line without entries, or of another form, is an error."""
    row = spark.read.text(path).select(token_format(F.try_element_at(tokens(F.col("value")), F.lit(2))).alias("t")).first()
    if row is None or row["t"] is None:
        raise ValueError(f"the first line of {path} is neither libsvm nor libffm")
    return row["t"]


def parse_samples(lines: DataFrame, file_type: str, mode: str = "FAILFAST", value_col: str = "value") -> DataFrame:
    """Samples from a table of lines; all columns but the line stay.

    FAILFAST ends with an error at a line that can't be read, DROPMALFORMED leaves such
    lines out, PERMISSIVE keeps them in _corrupt_record, with y and x null. One bad line
    never costs another one.
    """
    if file_type not in ("libsvm", "libffm"):
        raise ValueError(f"unknown file type {file_type}")
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    n = 2 if file_type == "libsvm" else 3
    rest = [c for c in lines.columns if c != value_col]
    line = F.col(value_col)
    plain = F.coalesce(line.rlike(_PLAIN % (r"\d{1,9}:" if n == 3 else "")), F.lit(False))
    cut = lines.select(*rest, line.alias("_line"), plain.alias("_plain"), F.when(plain, F.split(line, " ")).otherwise(tokens(line)).alias("_t"))

    def short(p: Column) -> Column:
        field = F.lit(0) if n == 2 else p[0].try_cast("int")
        return F.struct(field.alias("field"), p[n - 2].try_cast("int").alias("feat"), p[n - 1].try_cast("float").alias("value"))

    def entry(p: Column) -> Column:
        part = [F.try_element_at(p, F.lit(i + 1)) for i in range(n)]
        field = F.when(F.size(p) == n, F.lit(0) if n == 2 else _whole(part[0]))  # null: not an entry
        return F.struct(field.alias("field"), _whole(part[n - 2]).alias("feat"), _real(part[n - 1]).alias("value"))

    first, parts = F.try_element_at("_t", F.lit(1)), F.transform(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda t: F.split(t, ":"))
    read_as = lambda y, of: F.struct(y.alias("y"), F.transform(parts, of).alias("x"))
    row = F.when(F.col("_plain"), read_as(first.try_cast("int"), short)).otherwise(read_as(_whole(first), entry))
    # what is read is used several times below; a generator of one row keeps it from being computed for each use
    read = cut.select(*rest, "_line", "_plain", F.explode(F.array(row)).alias("_r")).select(*rest, "_line", "_plain", F.col("_r.y").alias("_y"), F.col("_r.x").alias("_x"))
    good = F.col("_y").isNotNull() & ~F.exists("_x", lambda e: e.field.isNull() | e.feat.isNull() | e.value.isNull())
    good = F.col("_plain") | F.coalesce(good, F.lit(False))
    x = F.filter("_x", lambda e: e.value != 0)
    y = (F.col("_y") > 0).cast("int")
    if mode == "DROPMALFORMED":
        return read.filter(good).select(*rest, y.alias("y"), x.alias("x"))
    if mode == "PERMISSIVE":
        return read.select(*rest, F.when(good, y).alias("y"), F.when(good, x).alias("x"), F.when(~good, F.col("_line")).alias("_corrupt_record"))
    fail = F.raise_error(F.concat(F.lit("wrong input: "), F.coalesce("_line", F.lit("null"))))
    return read.select(*rest, F.when(good, y).otherwise(fail.cast("int")).alias("y"), F.when(good, x).otherwise(fail.cast(f"array<{ENTRY}>")).alias("x"))


def parse_by_pattern(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """A tolerant reading of libffm: whatever looks like unsigned field:feat:value is an entry, anything else is passed over."""
    found = F.regexp_extract_all(F.col(value_col), F.lit(r"(\d+):(\d+):(\d+(?:\.\d+)?)"), F.lit(0))
    parts = F.transform(found, lambda t: F.split(t, ":"))
    x = F.transform(parts, lambda p: F.struct(p[0].try_cast("int").alias("field"), p[1].try_cast("int").alias("feat"), p[2].try_cast("float").alias("value")))
    rest = [c for c in lines.columns if c != value_col]
    return lines.select(*rest, (F.coalesce(_whole(F.trim(value_col)), F.lit(0)) > 0).cast("int").alias("y"), F.filter(x, lambda e: e.value != 0).alias("x"))


def parse_garbage_as_zero(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Another tolerant reading of libffm: numbers that can't be read are 0."""
    t = tokens(F.col(value_col), " :")
    zero = lambda c: F.coalesce(c, F.lit(0))
    i = F.sequence(F.lit(0), F.greatest(F.floor((F.size(t) - 1) / 3).cast("int") - 1, F.lit(0)))
    at = lambda k: F.try_element_at(F.col("_t"), k)
    x = F.transform(F.col("_i"), lambda k: F.struct(zero(_whole(at(3 * k + 2))).alias("field"), zero(_whole(at(3 * k + 3))).alias("feat"), F.coalesce(_real(at(3 * k + 4)), F.lit(0).cast("float")).alias("value")))
    rest = [c for c in lines.columns if c != value_col]
    base = lines.select(*rest, t.alias("_t"), i.alias("_i"))
    row = F.struct((zero(_whole(at(F.lit(1)))) > 0).cast("int").alias("y"), F.filter(x, lambda e: e.value != 0).alias("x"))
    # Spark filters empty arrays away before it explodes them, and would read each line again for that; a generator of one row keeps it from doing so
    return base.select(*rest, F.explode(F.array(row)).alias("_r")).select(*rest, F.col("_r.y").alias("y"), F.col("_r.x").alias("x"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with seq: 0, 1, 2 and so on in the order of file paths and of lines within a file.

    Lines are numbered within their part of a file as they are read; the parts are laid
    end to end by their sums. No line is sorted or shuffled.
    """
    part = ["_file", "_start"]
    given = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    given = materialize(given, "lines")
    parts = given.groupBy(*part).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = parts.groupBy("_file").agg(F.sum("_n").alias("_n")).select("_file", before(Window.orderBy("_file")).alias("_base"))  # a row for each file
    laid = parts.select(*part, (before(Window.partitionBy("_file").orderBy("_start")) - F.col("_first")).alias("_shift")).join(files, "_file")
    return given.join(laid, part).select((F.col("_base") + F.col("_shift") + F.col("_id")).alias("seq"), "value")


def read_samples(spark: SparkSession, path: str, file_type: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    return parse_samples(read_lines(spark, path), file_type or detect_format(spark, path), mode)


def with_chunks(samples: DataFrame, rows: int = 20_000) -> DataFrame:
    """chunk: rows of about that many seq values next to each other, without sorting all of them."""
    return samples.withColumn("chunk", F.floor(F.col("seq") / rows).cast("long"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)
