"""Table to sparse text: python -m sparseloom.encode_cli --data_path ... --train_output_path ... --cat_cols 1,3 ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from sparseloom.functions.params import EncodeParams, flag
from sparseloom.operators.encode import lines, shuffled, transform
from sparseloom.session import build_session
from sparseloom.sources.sparse_text import write_lines
from sparseloom.sources.tabular import read_train_eval
from sparseloom.storage import materialize


def columns(text: str) -> tuple[int, ...]:
    return tuple(int(c) for c in text.split(",") if c.strip())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparseloom-encode", description="Encode a table as libsvm or libffm text.", allow_abbrev=False)
    for name in ("data_path", "train_path", "eval_path"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--train_output_path", required=True)
    p.add_argument("--eval_output_path", required=True)
    p.add_argument("--label_col", type=int, default=0)
    p.add_argument("--cat_cols", type=columns, default=())
    p.add_argument("--num_cols", type=columns, default=())
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--neg_sampling", type=flag, default=False)
    p.add_argument("--num_neg", type=int, default=0)
    p.add_argument("--normalize", type=flag, default=False)
    p.add_argument("--file_type", choices=("libsvm", "libffm"), default="libffm")
    p.add_argument("--train_share", type=float, default=0.8)
    p.add_argument("--sep", default=",")
    p.add_argument("--seed", type=int, default=42)
    return p


def main(argv: list[str] | None = None) -> int:
    given = vars(parser().parse_args(sys.argv[1:] if argv is None else argv))
    paths = {k: given.pop(k) for k in ("data_path", "train_path", "eval_path", "train_output_path", "eval_output_path")}
    p = EncodeParams(**given)
    spark = build_session("sparseloom-encode")
    train, held = read_train_eval(spark, p, paths["data_path"], paths["train_path"], paths["eval_path"])
    # numbers of rows are drawn once and kept, as later steps go by them
    train, held = (materialize(d.withColumn("_seq", F.monotonically_increasing_id()), "table") for d in (train, held))
    a, b = transform(train, held, p, "_seq")
    write_lines(lines(shuffled(a, p.seed, "seq"), p.file_type), paths["train_output_path"])
    write_lines(lines(b, p.file_type), paths["eval_output_path"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
