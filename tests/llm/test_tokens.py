import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from sparseloom.llm import bpe, records
from sparseloom.llm.common import shared_path

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
DATA = open(RANKS, "rb").read()
OURS = bpe.Bpe(DATA, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}, special_tokens={})
TOKENS = records.Tokens(open(JSON, encoding="utf-8").read())
LIBRARY = tokenizers.Tokenizer.from_file(JSON)


def as_ids(text):
    return np.array(THEIRS.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r\x0b\x1c\x85  abcdeABC'sltr0123é日𝒳.,!-_<|endoftext|>")), max_size=80))
def test_any_text(text):
    ids = OURS.batch([text])[0]
    assert ids == as_ids(text) and OURS.ranks.decode(ids) == text.encode()
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert TOKENS.batch([text])[0] == np.array(want, "<u4").tobytes()


def test_added_tokens():
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\nx  <|endoftext|", "<|endo", ""):
        assert TOKENS.batch([text, "other words"])[0] == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_long_pieces():
    rnd = random.Random(3)
    for text in ("a" * 3001, "x" * 100_000, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), "ab" * 2000, " " * 999, "é" * 700, "".join(rnd.choice("abcdefg") for _ in range(4000)), "\n" * 500 + "x"):
        assert OURS.batch([text])[0] == as_ids(text)


def test_memory_runs_over(monkeypatch):
    monkeypatch.setattr("sparseloom.llm.pieces.MEMORY", 50)
    rnd = random.Random(4)
    small = bpe.Bpe(DATA, public_tokenizers.PATTERN)
    for _ in range(20):
        batch = [" ".join("".join(rnd.choices("abcde\n", k=rnd.randint(1, 6))) for _ in range(30)) for _ in range(5)]
        assert small.batch(batch) == [as_ids(t) for t in batch]


def test_encode_and_decode(make_docs, edges):
    ids = bpe.encode(make_docs(edges), RANKS)
    got = sorted((str(r["doc_id"]), tuple(r["ids"])) for r in ids.collect())
    assert got == sorted((str(i), tuple(THEIRS.encode_ordinary(t or ""))) for i, t in edges)
    back = sorted((str(r["doc_id"]), bytes(r["data"])) for r in bpe.decode(ids, RANKS).collect())
    assert back == sorted((str(i), (t or "").encode()) for i, t in edges)


def test_records_round_trip(spark, make_docs, edges):
    edges = [*edges, (10, "a <|endoftext|> b<|endoftext|>"), (11, "<|endoftext|>"), (12, "<|endoftext |>"), (13, "tall words of some length " * 150_000)]
    path, index = shared_path(spark, "r"), shared_path(spark, "i")
    records.write_records(make_docs(edges).repartition(5), path, JSON, file_bytes=300)
    records.write_index(spark, path, index)
    want = sorted(((i is not None, i or 0), (t or "")) for i, t in edges)
    want = [(i, LIBRARY.encode(t, add_special_tokens=False).ids + [0]) for (has, i), t in want for i in [i if has else None]]
    rows = records.with_global_start(records.read_records(spark, path), spark.read.parquet(index)).collect()
    rows.sort(key=lambda r: r["start"])
    assert [(r["doc_id"], r["ids"]) for r in rows] == want
    assert [r["start"] for r in rows] == np.cumsum([0, *(len(x) for _, x in want[:-1])]).tolist()
    assert len({(r["shard"], r["chunk"]) for r in rows}) > 5
    assert next(ids for i, ids in want if i == 10)[2] == 50256
    some = [[(r["doc_id"], r["ids"]) for r in records.shuffled_records(spark, path, index, seed).collect()] for seed in (1, 1, 2)]
    assert some[0] == some[1] != some[2] and sorted(map(str, some[0])) == sorted(map(str, want))


def test_damage_is_seen():
    data = records.frame(7, np.arange(5, dtype="<u4").tobytes(), 2) + records.frame(None, b"", 4)
    assert [(i, ids) for _, _, i, ids in records.frames(data)] == [(7, np.arange(5, dtype="<u4").tobytes()), (None, b"")]
    for at in (0, 9, 20, len(data) - 4):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(Exception):
            list(records.frames(bytes(bad)))


def test_file_numbers(spark, tmp_path):
    """The names that Spark gives hold a random part, which may look like a number of a chunk."""
    names = {"part-00003-1b2c3d4e-c123-4aaa-c456-0123456789ab-c002.txt": (3, 2), "part-00012-c1234567-0000-4000-8000-c00000000000-c000.txt": (12, 0), "part-100001-aaaaaaaa-c111-4aaa-8aaa-aaaaaaaaaaaa-c010.txt": (100001, 10)}
    for n in names:
        (tmp_path / n).write_bytes(b"x")
    got = records._files(spark, str(tmp_path)).select("shard", "chunk").collect()
    assert sorted(map(tuple, got)) == sorted(names.values())
