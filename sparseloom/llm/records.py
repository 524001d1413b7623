"""Token ids as length-delimited binary records, with an offset index for reads in any order.

A file holds records one after another, in ascending order of document ids; the
files of a folder follow each other by number. A record is

    8 bytes   length of the payload, unsigned, little-endian
    4 bytes   masked CRC-32 of these 8 bytes
    n bytes   payload: 1 byte for a null id (1) or not (0), 8 bytes document id,
              1 byte width of an id (2 or 4), 4 bytes number of ids, the ids
    4 bytes   masked CRC-32 of the payload
    1 byte    line feed

The mask rotates a checksum by 15 bits and adds a constant, so that a checksum of
data that hold checksums stays telling. Spark's own file writer puts the bytes
down, so any store that Spark can write serves, and a task that is run again
leaves no half-written file.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparseloom.llm.common import read_table, shared_path, small_batches, texts
from sparseloom.llm.pieces import Encoder
from sparseloom.storage import remove_at_end

#: Fixed values of the format.
MASK = 0xA282EAD8
HEAD, INNER, TAIL = struct.Struct("<QI"), struct.Struct("<BqBI"), struct.Struct("<I")
#: Bytes of one file, unless a single record is longer; it bounds what a task that reads a file holds.
FILE_BYTES = 32 << 20
INDEX = "shard int, chunk int, seq long, doc_id long, offset long, length long, n_tokens long, start long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """A record of ids given as little-endian unsigned 32-bit integers."""
    n = len(ids) // 4
    stored = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = INNER.pack(doc_id is None, doc_id or 0, width, n) + stored
    size = struct.pack("<Q", len(payload))
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload)), b"\n"))


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, bytes]]:
    """Offset, length, document id and ids (little-endian, 32 bits) of each record; a wrong checksum is an error."""
    at = 0
    while at < len(data):
        n, crc = HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != crc:
            raise ValueError(f"the length at offset {at} is damaged")
        end = at + HEAD.size + n
        payload = data[at + HEAD.size : end]
        if masked(payload) != TAIL.unpack_from(data, end)[0]:
            raise ValueError(f"the record at offset {at} is damaged")
        null, doc_id, width, count = INNER.unpack_from(payload)
        ids = payload[INNER.size :]
        if len(ids) != width * count:
            raise ValueError(f"the record at offset {at} has not {count} ids")
        length = end + TAIL.size + 1 - at
        yield at, length, None if null else doc_id, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
        at += length


class Tokens(Encoder):
    """Ids of the tokenizers library. Its pre-tokenizer splits by the byte-level pattern, so pieces between safe cuts can be remembered.

    A text that holds an added token is handed to the library as a whole: these are found before the pattern splits.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith(space)
        super().__init__(self._pieces)

    def batch(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        rest = list(texts)
        for i in whole:
            rest[i] = ""
        out = super().batch(rest)
        for i in whole:
            out[i] = array("I", self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out

    def _pieces(self, pieces: list[str], after_space: bool) -> list[bytes]:
        encode = self.tokenizer.encode_batch_fast
        if not after_space:
            return [array("I", e.ids).tobytes() for e in encode(pieces, add_special_tokens=False)]
        out: list[bytes] = []
        for k in range(0, len(pieces), 500):
            part = pieces[k : k + 500]
            # joined by their spaces the pieces are one text; each begins at the only token that starts with a space
            ids = np.array(encode(["".join([f" {p}" for p in part])], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part):
                data, ends = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                out += [data[i:j] for i, j in zip(ends, ends[1:])]
            else:
                out += [array("I", e.ids).tobytes() for e in encode([f" {p}" for p in part], add_special_tokens=False)]
        return out


_workers: dict[int, Tokens] = {}


def _tokens(definition: str) -> Tokens:
    key = hash(definition)
    if key not in _workers:
        _workers[key] = Tokens(definition)
    return _workers[key]


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode whole texts, append end_id to each and write the records to path.

    A string of an added token in a text becomes that token's id, as the library has it.

    Null and empty texts become records of end_id alone. Rows without an id come
    first, with the null flag set. Rows of one id follow each other, by text; equal
    rows are written as often as they occur. An empty table leaves a folder without
    records. Other columns than id and text are not read.

    The texts are dealt out by ranges of ids before they are encoded: each is moved
    once, encoded once, and a range is a file or more, of file_bytes at most or of one record.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a definition of a few MB, read by the driver
        definition = f.read()
    sent = spark.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(sent.value)
        width = 2 if max(tokens.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        end = struct.pack("<I", end_id)
        block: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            # the writer sets the line feed after the last record
            return pa.RecordBatch.from_arrays([pa.array([b"".join(block)[:-1]], pa.binary())], ["block"])

        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), tokens.batch(b.column(1).to_pylist())):
                record = frame(i, ids + end, width)
                if block and size + len(record) > file_bytes:
                    yield file()
                    block.clear()
                    size = 0
                block.append(record)
                size += len(record)
        if block:
            yield file()

    base = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    ordered = small_batches(base).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # a row is a file
    ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.col("path")
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract(name, r"part-(\d+)-[^/]*$", 1).cast("int").alias("shard"),
        F.coalesce(F.expr(r"try_cast(regexp_extract(path, '-c(\\d+)\\.[^/]*$', 1) AS int)"), F.lit(0)).alias("chunk"),
        "content",
    )


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Records with their place: shard, chunk, seq, doc_id, offset, length, n_tokens, start (ids before it in its file), ids_crc32 and ids (or null)."""
    schema = INDEX + ", ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, chunk, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                start, rows = 0, []
                for seq, (offset, length, doc_id, ids) in enumerate(frames(content.as_py())):
                    rows.append((shard, chunk, seq, doc_id, offset, length, len(ids) // 4, start, zlib.crc32(ids), np.frombuffer(ids, "<u4").tolist() if with_ids else None))
                    start += len(ids) // 4
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return _files(spark, path).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.list_(pa.int64())]
    names = ["shard", "chunk", "seq", "doc_id", "offset", "length", "n_tokens", "start", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Read all files back, check their records, and write the places of these as a table of its own: all columns of read_records but ids."""
    read_records(spark, path, with_ids=False).drop("ids").write.parquet(index_path)


def shuffled_records(spark: SparkSession, path: str, index_path: str, seed: int) -> DataFrame:
    """Whole records in an order that seed fixes: place (the sort key), doc_id, ids.

    Each file is read once; the index gives the places to cut it at.
    """
    index = spark.read.parquet(index_path).groupBy("shard", "chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "offset", "length"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, chunk, places, content in zip(*(b.column(i) for i in range(4))):
                data = content.as_py()
                for p in places.as_py():
                    _, _, doc_id, ids = next(frames(data[p["offset"] : p["offset"] + p["length"]]))
                    yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int32()), pa.array([chunk.as_py()], pa.int32()), pa.array([p["seq"]], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([np.frombuffer(ids, "<u4").tolist()], pa.list_(pa.int64()))], ["shard", "chunk", "seq", "doc_id", "ids"])

    cut = _files(spark, path).join(index, ["shard", "chunk"]).select("shard", "chunk", "places", "content").mapInArrow(run, "shard int, chunk int, seq long, doc_id long, ids array<long>")
    return cut.select(F.xxhash64(F.lit(seed), "shard", "chunk", "seq").alias("place"), "doc_id", "ids").orderBy("place")


def with_global_start(records: DataFrame, index: DataFrame) -> DataFrame:
    """start becomes the number of ids of all documents before, in earlier files too."""
    sums = index.groupBy("shard", "chunk").agg(F.sum("n_tokens").alias("n"))
    # sums over shards, a row for each task that wrote, then over the files of each
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", before(Window.orderBy("shard")).alias("first"))
    files = sums.select("shard", "chunk", before(Window.partitionBy("shard").orderBy("chunk")).alias("more"))
    base = files.join(shards, "shard").select("shard", "chunk", (F.col("first") + F.col("more")).alias("base"))
    return records.join(base, ["shard", "chunk"]).withColumn("start", F.col("start") + F.col("base")).drop("base")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, index_path = shared_path(spark, "records"), shared_path(spark, "records-index")
    write_records(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    write_index(spark, path, index_path)
    remove_at_end(spark, path)
    remove_at_end(spark, index_path)
    index = spark.read.parquet(index_path)  # what was read back from the files
    out = with_global_start(index, index)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_token_records": op1_token_records}
ORACLES: dict[str, str] = {}
