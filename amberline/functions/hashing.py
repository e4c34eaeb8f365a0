"""Order-free, engine-neutral pseudo-random values from keys.

md5 is used because it is the same in every engine and Spark version, so a
split or a sample never depends on row order, partitioning or a hash upgrade.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(*cols: Column) -> Column:
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def key_hash(*cols: Column) -> Column:
    """32 hex digits, uniform; used as a tie-breaker and a sampling order."""
    return F.md5(key_text(*cols))


def hex_to_int(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def unit_mod(key: Column, salt: str = "", modulus: int = 1000) -> Column:
    """Stable bucket 0..modulus-1 of a key; different salts are independent."""
    text = F.concat(key.cast("string"), F.lit(salt)) if salt else key.cast("string")
    return hex_to_int(F.substring(F.md5(text), 1, 8)) % F.lit(modulus)


# Cumulative Poisson(1) probabilities scaled to 16-bit draws.
POISSON1_STEPS = (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535)


def poisson1(draw16: Column) -> Column:
    """Poisson(1) weight of a uniform draw in 0..65535, by inverse CDF."""
    weight = F.lit(len(POISSON1_STEPS))
    for w in range(len(POISSON1_STEPS) - 1, -1, -1):
        weight = F.when(draw16 < POISSON1_STEPS[w], F.lit(w)).otherwise(weight)
    return weight
