"""Options of training and encoding."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, fields

MODELS = ("LR", "FM", "FFM")


def flag(text: str) -> bool:
    """yes, true, y, 1 or no, false, n, 0, in any case."""
    word = text.strip().lower()
    if word in ("yes", "true", "y", "1"):
        return True
    if word in ("no", "false", "n", "0"):
        return False
    raise ValueError(f"{text!r} is neither true nor false")


@dataclass(frozen=True)
class Params:
    """A model and how it is trained. Checked when made."""

    model_type: str = "FFM"
    n_fields: int = 8
    n_feats: int = 10_000
    n_factors: int = 16
    init_mean: float = 0.0
    init_stddev: float = 0.02
    w_alpha: float = 1e-4
    w_beta: float = 1.0
    w_l1: float = 0.1
    w_l2: float = 5.0
    n_epochs: int = 1
    online: bool = True
    #: 'parity': factors are 0 from their first use on; 'warm': they start from their initial values.
    factor_init: str = "parity"
    strict_loss: bool = False
    seed: int = 42
    #: What becomes of lines that can't be read: FAILFAST, DROPMALFORMED or PERMISSIVE.
    mode: str = "FAILFAST"
    train_data: str = ""
    eval_data: str = ""
    model_path: str = ""
    #: Where a task keeps what it has done, so that it goes on from there when it is run again.
    work_path: str = ""
    #: Bytes of text that a step of an online task takes, within files too; 0 for a whole file.
    batch_bytes: int = 0

    def __post_init__(self):
        object.__setattr__(self, "model_type", self.model_type.upper())
        if self.model_type not in MODELS:
            raise ValueError(f"model_type is one of {', '.join(MODELS)}, not {self.model_type}")
        if self.factor_init not in ("parity", "warm"):
            raise ValueError("factor_init is 'parity' or 'warm'")
        if self.mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
            raise ValueError("mode is FAILFAST, DROPMALFORMED or PERMISSIVE")
        for name in ("n_fields", "n_feats", "n_factors", "n_epochs"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} is at least 1")
        if self.w_alpha <= 0 or self.w_l1 < 0 or self.w_l2 < 0:
            raise ValueError("w_alpha is above 0, w_l1 and w_l2 are not below it")

    def check_format(self, file_type: str) -> None:
        if self.model_type == "FFM" and file_type != "libffm":
            raise ValueError("an FFM needs the fields of libffm data")


def parser() -> argparse.ArgumentParser:
    """Every option of Params under its own name; an unknown one ends the program with a message."""
    p = argparse.ArgumentParser(prog="sparseloom", description="Train and evaluate LR, FM and FFM models with FTRL-Proximal on Spark.", allow_abbrev=False)
    for f in fields(Params):
        kind = {"bool": flag, "int": int, "float": float}.get(f.type, str)
        p.add_argument(f"--{f.name}", type=kind, default=f.default)
    return p


def parse_options(argv: list[str]) -> Params:
    return Params(**vars(parser().parse_args(argv)))


@dataclass(frozen=True)
class EncodeParams:
    """How a table becomes sparse samples. Columns are given by position; cat_cols come first in the order of fields."""

    label_col: int = 0
    cat_cols: tuple[int, ...] = ()
    num_cols: tuple[int, ...] = ()
    threshold: float = 0.0
    neg_sampling: bool = False
    num_neg: int = 0
    normalize: bool = False
    file_type: str = "libffm"
    train_share: float = 0.8
    seed: int = 42
    header: bool = True
    sep: str = field(default=",")
