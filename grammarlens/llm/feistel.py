"""A keyed permutation of the 64-bit numbers, as plain column arithmetic.

Six Feistel rounds over two 32-bit halves. Distinct numbers stay distinct, so an
order or a threshold on the permuted number has no ties and no collisions, and it
depends on nothing but the number and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: One odd multiplier for each round; under 2^31, so that no product leaves 63 bits.
MULTIPLIERS = (1540483477, 2146121005, 1812433253, 739982445, 2057660397, 1664525341)
ROUNDS = len(MULTIPLIERS)
HI, LO = "_hi", "_lo"


def _round(half: str, key: str, i: int, xor: str) -> str:
    """The middle bits of a product. It names its half once: an optimizer that puts the
    rounds into one another then makes a tree of tens of nodes, not of thousands."""
    return f"((({xor.format(half, key)}) * {MULTIPLIERS[i]}) >> 16) & {MASK}" if "xor" in xor else f"shiftright(({xor.format(half, key)}) * {MULTIPLIERS[i]}, 16) & {MASK}"


def keys_sql(seed: str, dialect: str = "spark") -> list[str]:
    """The round keys of a seed, as SQL; null seeds count as 0."""
    xor = "xor({}, {})" if dialect == "duckdb" else "({} ^ {})"
    out = []
    for i in range(ROUNDS):
        x = f"((coalesce({seed}, 0) & {MASK}) + {(i + 1) * 1640531527 & MASK}) & {MASK}"
        for r in range(3):
            x = "(" + _round(x, str((r + i + 1) * 2654435769 & MASK), (i + 2 * r) % ROUNDS, xor) + ")"
        out.append(x)
    return out


def with_keys(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """seeds with the round keys _k0 to _k5; meant for the small side of a join."""
    return seeds.selectExpr("*", *(f"cast({k} as bigint) as _k{i}" for i, k in enumerate(keys_sql(seed))))


def permuted(df: DataFrame, number: str) -> DataFrame:
    """df, which has the round keys, with the permuted number's halves instead of them."""
    keys = [f"_k{i}" for i in range(ROUNDS)]
    keep = [f"`{c}`" for c in df.columns if c not in keys]
    out = df.selectExpr(*keep, *keys, f"shiftrightunsigned({number}, 32) as {HI}", f"{number} & {MASK} as {LO}")
    for i in range(ROUNDS):
        out = out.selectExpr(*keep, *keys[i + 1 :], f"{LO} as {HI}", f"{HI} ^ ({_round(LO, f'_k{i}', i, '({} ^ {})')}) as {LO}")
    return out


def text_key(text: str) -> str:
    """The 64-bit key of a text as SQL: the first half of its MD5."""
    part = lambda at: f"cast(conv(substring(md5({text}), {at}, 8), 16, 10) as bigint)"
    return f"shiftleft({part(1)}, 32) | {part(9)}"


def text_key_sql(text: str) -> tuple[str, str]:
    """The halves of text_key in DuckDB."""
    return tuple(f"cast('0x' || substr(md5({text}), {at}, 8) as bigint)" for at in (1, 9))


def permuted_sql(source: str, number: str | tuple[str, str], seed: str, columns: str) -> str:
    """The same in DuckDB: columns of source, and hi and lo of number (or of its two halves) under seed."""
    keys = ", ".join(f"cast({k} as bigint) as k{i}" for i, k in enumerate(keys_sql(seed, "duckdb")))
    hi, lo = (f"({number}) >> 32", f"({number}) & {MASK}") if isinstance(number, str) else number
    sql = f"select {columns}, {keys}, {hi} as hi, {lo} as lo from {source}"
    for i in range(ROUNDS):
        sql = f"select * replace (lo as hi, xor(hi, {_round('lo', f'k{i}', i, 'xor({}, {})')}) as lo) from ({sql})"
    return f"select * exclude ({', '.join(f'k{i}' for i in range(ROUNDS))}) from ({sql})"


def under_rate(rate: str) -> Column:
    """The permuted number lies under rate x 2^64. A null rate selects nothing."""
    return F.expr(
        f"case when {rate} >= 1 then true when {rate} > 0 then {HI} < floor({rate} * 4294967296D)"
        f" or ({HI} = floor({rate} * 4294967296D) and {LO} < floor(({rate} * 4294967296D - floor({rate} * 4294967296D)) * 4294967296D)) else false end"
    )


def sample(rows: DataFrame, number: str, seed: str = "seed", rate: str = "sample_rate") -> DataFrame:
    """Rows whose number, permuted by the row's own seed, lies under the row's rate.

    Stateless: no row's fate depends on another row, so a sample stays the same in
    every layout and only grows as rows are added or a rate is raised. Null numbers,
    null rates and rates of 0 or less select nothing; a null seed counts as 0; equal
    numbers share their fate; all columns come back, whatever their names.
    """
    packed = rows.where(F.col(number).isNotNull()).select(F.struct("*").alias("_row"), F.col(number).alias("_number"), F.col(seed).alias("_seed"), F.col(rate).alias("_rate"))
    return permuted(with_keys(packed, "_seed"), "_number").where(under_rate("_rate")).select("_row.*")
