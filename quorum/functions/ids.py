"""Ids and seeds derived from the parts of a request by SHA-256."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts stand between quotes if they are strings, joined by the unit separator.
SEPARATOR = "\x1f"
ID_DIGITS, SEED_DIGITS = 24, 16
#: A prime below 2^31 under which x^5 is a permutation, and what is added after it.
PRIME, ADDED = 2**31 - 1, 1_234_567_891


def _digest(parts: list[tuple[Column, bool]]) -> Column:
    shown = [F.concat(F.lit("'"), c.cast("string"), F.lit("'")) if text else c.cast("string") for c, text in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(c, F.lit("None")) for c in shown]), 256)


def derived_id(*parts: tuple[Column, bool]) -> Column:
    """24 hex digits; each part is (column, whether it is a string)."""
    return F.substring(_digest(list(parts)), 1, ID_DIGITS)


def derived_seed(*parts: tuple[Column, bool]) -> Column:
    """An unsigned 64-bit number, as decimal(20, 0)."""
    return F.conv(F.substring(_digest(list(parts)), 1, SEED_DIGITS), 16, 10).cast("decimal(20,0)")


def cache_key(prompt: Column, model: Column, seed: Column, params: Column) -> Column:
    """Names a completion by all that it depends on; params is the text of a JSON object, in any order of its keys."""
    entries = F.array_sort(F.map_entries(F.from_json(params, "map<string,string>")))
    listed = F.coalesce(F.to_json(entries), params)  # what is no object stands for itself
    return F.sha2(F.to_json(F.struct(model.alias("model"), listed.alias("params"), prompt.alias("prompt"), seed.alias("seed"))), 256)


def hash_number(seed: int | Column, tag: str, *parts: Column) -> Column:
    """48 bits by hashing: a counter-based random number that depends on nothing but its arguments."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed, F.lit(tag), *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def mixed_numbers(*parts: int | np.ndarray) -> np.ndarray:
    """31 bits from whole numbers, for many draws at once: each is added to a state that is then raised to its fifth power.

    Products stay below 2^62, so that SQL can do the same; two rounds more follow the last part.
    """
    x = np.int64(0)
    for part in (*parts, 0, 0):
        x = (x + part) % PRIME
        square = x * x % PRIME
        x = (square * square % PRIME * x + ADDED) % PRIME
    return np.asarray(x)
