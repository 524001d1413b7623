"""spark-submit entry: python -m sparseloom.cli --train_data ... --model_type LR ..."""

from __future__ import annotations

import sys

from sparseloom.functions.params import parse_options
from sparseloom.plans.tasks import run
from sparseloom.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = parse_options(sys.argv[1:] if argv is None else argv)
    _, epochs = run(build_session("sparseloom"), p)
    for i, e in enumerate(epochs):
        print(f"epoch {i}: train loss {e.train_loss:.6f}" + (f", eval loss {e.eval_loss:.6f}" if e.eval_loss is not None else "") + f", {e.seconds:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
