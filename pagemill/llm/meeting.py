"""Rows meet a bounded amount of data of their group, however the groups are sized.

If what all groups hold together is small (it is measured, not assumed), it is sent to every task and the
rows stay where they are. Otherwise rows and groups are joined by key, and a group of more
than ``per_salt`` rows is split: its rows over salts, its data repeated for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def meet(rows: DataFrame, groups: DataFrame, key: str, spread_by: list[str], held_bytes: int, limit: int = BROADCAST_BYTES, per_salt: int = 20_000) -> DataFrame:
    """Left join of rows with groups on ``key``. groups has one row a key, with the number of its rows as ``total``.

    Groups that are split number at most rows / per_salt; that list is sent to every task.
    """
    if held_bytes <= limit:
        return rows.join(F.broadcast(groups.drop("total")), key, "left")
    salts = F.greatest(F.ceil(F.col("total") / per_salt), F.lit(1)).cast("int")
    split = groups.where(F.col("total") > per_salt).select(key, salts.alias("_salts"))
    salted = rows.join(F.broadcast(split), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("total")
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
