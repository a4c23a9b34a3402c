"""Records that differ only in formatting, collapsed without a hot group in one task.

Two values agree when they are equal after white space, letter case and punctuation are
removed and the fields of the url's query, set apart by & or ;, are put in order. The canonical key of a record
is the 128-bit digest of the two canonical texts; an absent or empty content hash (or one
of punctuation alone) has no key, so such a record has no copies; an absent url counts as the
empty text, which equals other empty urls only.

The keys are counted exactly with partial (map-side) counts. Keys of more than ``hot``
records are few, and only the MOST_HOT largest count as hot, so what is broadcast is bounded however large the
table. The records of hot keys are aggregated on two levels, by (key, salt) and then by key;
all others go through a single shuffle. The representative is the smallest identifier, so
ties cannot change the result; an identifier given twice yields its pair twice. The keys are derived once
and kept, 24 bytes a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: Hot keys at most; beyond them a key has at most records / MOST_HOT records.
MOST_HOT = 100_000
_NOT_TEXT = r"[^\p{L}\p{M}\p{N}]+"


def squeeze(c: Column) -> Column:
    """Lower case letters, marks and digits of a text, nothing else; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _NOT_TEXT, "")


def canonical_url(url: Column) -> Column:
    """The address squeezed, then the squeezed query fields in order; fields stay apart."""
    url = F.coalesce(url, F.lit(""))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.regexp_replace(url, r"^[^?]*\?", ""), "#", 1)).otherwise(F.lit(""))
    rest = F.regexp_replace(F.regexp_extract(url, r"^[^?]*\?[^#]*(#.*)?$", 1), r"^#", "")
    fields = F.array_sort(F.filter(F.transform(F.split(query, r"&amp;|[&;]"), squeeze), lambda f: f != ""))
    return F.concat_ws("?", squeeze(F.substring_index(url, "?", 1)), F.array_join(fields, "&"), squeeze(rest))


def canonical_key(url: Column, content_hash: Column) -> Column:
    content = squeeze(content_hash)
    return F.when(content != "", F.unhex(F.md5(F.concat_ws("\n", canonical_url(url), content))))


def keyed(records: DataFrame, id_col: str = "record_id", url: str = "url", content: str = "content_hash") -> DataFrame:
    """(id, key) of every record, key null where it has none; the input's other columns are not read."""
    return checkpoint(records.select(F.col(id_col).alias("id"), canonical_key(F.col(url), F.col(content)).alias("key")))


def _with_key(k: DataFrame) -> DataFrame:
    return k.where(F.col("key").isNotNull() & F.col("id").isNotNull())


def hot_keys(keys: DataFrame, hot: int) -> DataFrame:
    """Keys of more than ``hot`` records, counted exactly, the largest MOST_HOT of them."""
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).orderBy(F.desc("n"), "key").limit(MOST_HOT).select("key")


def _split(keys: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    found = checkpoint(hot_keys(keys, hot))  # at most MOST_HOT digests of 16 bytes
    cold = keys.join(F.broadcast(found), "key", "left_anti")
    return keys.join(F.broadcast(found), "key", "left_semi"), cold


def collapse(records: DataFrame, hot: int = 100_000, salts: int = 64, **columns: str) -> DataFrame:
    """One row per distinct canonical record: (record_id, copies), copies counting the record.

    Rows without a key stay, each for itself, with copies = 1.
    """
    id_col, url, content = columns.get("id_col", "record_id"), columns.get("url", "url"), columns.get("content", "content_hash")
    every = keyed(records, id_col, url, content)
    warm, cold = _split(_with_key(every), hot)
    salted = warm.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    two = salted.groupBy("key").agg(F.min("id").alias("record_id"), F.sum("n").alias("copies"))
    one = cold.groupBy("key").agg(F.min("id").alias("record_id"), F.count(F.lit(1)).alias("copies"))
    alone = every.where(F.col("key").isNull()).select(F.col("id").alias("record_id"), F.lit(1).cast("long").alias("copies"))
    return one.select("record_id", "copies").unionByName(two.select("record_id", "copies")).unionByName(alone)


def copies(records: DataFrame, hot: int = 100_000, salts: int = 64, **columns: str) -> DataFrame:
    """(record_id_a, record_id_b): representative and every other record of its group.

    A cold group streams through its one shuffle, sorted, behind its first identifier; the
    representatives of the hot keys, at most MOST_HOT, are joined back to their records unshuffled.
    """
    keys = keyed(records, columns.get("id_col", "record_id"), columns.get("url", "url"), columns.get("content", "content_hash"))
    warm, cold = _split(_with_key(keys), hot)
    one = cold.select(F.first("id").over(Window.partitionBy("key").orderBy("id")).alias("a"), F.col("id").alias("b"))
    salted = warm.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("id"))
    reps = salted.groupBy("key").agg(F.min("id").alias("a"))
    two = warm.join(F.broadcast(reps), "key").select("a", F.col("id").alias("b"))
    both = one.unionByName(two)
    return both.where(F.col("a") != F.col("b")).select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))
