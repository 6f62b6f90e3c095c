"""Keyed hashes: every sample and bootstrap draw is a function of a key, never of row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_sha(prefix: str, *cols: Column | str) -> Column:
    """Hex SHA-256 of prefix and columns joined by ':'."""
    text = F.concat_ws(":", F.lit(prefix), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.sha2(text.cast("binary"), 256)


def uniform(prefix: str, *cols: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the keyed hash."""
    return F.conv(F.substring(keyed_sha(prefix, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def opaque_id(salt: str, *cols: Column | str, length: int = 16, bits: int = 1) -> Column:
    """Stable opaque id: the first characters of sha1 (bits=1) or sha256 of salt and columns."""
    text = F.concat_ws(":", F.lit(salt), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).cast("binary")
    return F.substring(F.sha1(text) if bits == 1 else F.sha2(text, bits), 1, length)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over ordered parts, each preceded by its length so that parts cannot run together."""
    joined = F.concat_ws("|", *[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts])
    return F.sha2(joined.cast("binary"), 256)


def case_set_hash(df, key: str) -> str:
    """Order-free SHA-256 of the distinct keys of a table.

    Keys are hashed one by one and the digests summed, so nothing but one row reaches the driver."""
    words = [F.conv(F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    row = df.select(key).distinct().agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)]).first()
    import hashlib

    return hashlib.sha256(":".join(map(str, row)).encode()).hexdigest()


#: Cumulative probabilities of a Poisson(1) count of 0, 1, ..., 7.
POISSON_ONE = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def poisson_weight(u: Column) -> Column:
    """Times drawn: Poisson(1) by inverse CDF of a uniform number."""
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON_ONE), F.lit(0)).cast("bigint")
