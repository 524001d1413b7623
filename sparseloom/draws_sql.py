"""The draws of functions.expressions in SQL, for the oracles: XXH64 as Spark's xxhash64 chains it over columns."""

from __future__ import annotations

#: Primes of XXH64 and the seed of Spark's xxhash64. Fixed values.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
SEED = 42
_WRAP = "18446744073709551616::UHUGEINT"


def _times(x: str, p: int, plus: int = 0) -> str:
    return f"(({x})::UHUGEINT * {p}::UHUGEINT + {plus}::UHUGEINT) % {_WRAP}"


def _turn(x: str, r: int) -> str:
    return f"((({x})::UHUGEINT * {1 << r}::UHUGEINT) % {_WRAP} + ({x})::UHUGEINT // {1 << (64 - r)}::UHUGEINT)"


def _xor(x: str, y: str) -> str:
    return f"xor(({x})::UBIGINT, ({y})::UBIGINT)::UHUGEINT"


def _shifted(x: str, r: int) -> str:
    return _xor(x, f"({x})::UHUGEINT // {1 << r}::UHUGEINT")


def hashed(table: str, *columns: tuple[str, str]) -> str:
    """A subquery: all columns of a table (or subquery), and h, the hash of columns given as (kind, expression); kind is 'int' or 'long'."""
    sql, seed = f"(SELECT *, {SEED}::UHUGEINT AS h FROM {table})", "h"
    step = lambda inner, h: f"(SELECT * REPLACE ({h} AS h) FROM {inner})"
    for kind, x in columns:
        bits = 64 if kind == "long" else 32
        whole = f"((({x})::HUGEINT + {1 << bits}::HUGEINT) % {1 << bits}::HUGEINT)::UHUGEINT"
        if kind == "long":
            part = _times(_turn(_times(whole, P2), 31), P1)
            sql = step(sql, _xor(f"({seed} + {P5}::UHUGEINT + 8) % {_WRAP}", part))
            sql = step(sql, _times(_turn("h", 27), P1, P4))
        else:
            sql = step(sql, _xor(f"({seed} + {P5}::UHUGEINT + 4) % {_WRAP}", _times(whole, P1)))
            sql = step(sql, _times(_turn("h", 23), P2, P3))
        for shift, prime in ((33, P2), (29, P3), (32, None)):
            sql = step(sql, _shifted("h", shift))
            if prime:
                sql = step(sql, _times("h", prime))
    return sql


#: h as Spark's signed number, as a draw of 53 bits, and as an even number in [0, 1).
SIGNED = f"(CASE WHEN h >= {1 << 63}::UHUGEINT THEN h::HUGEINT - {1 << 64}::HUGEINT ELSE h::HUGEINT END)::BIGINT"
DRAW = f"(h % {1 << 53}::UHUGEINT)::BIGINT"
UNIFORM = f"({DRAW} / {float(1 << 53)}::DOUBLE)"
