"""A mixture of sources with target shares of the tokens, repeats capped, shares reported.

Every source's documents are laid end to end in a fixed pseudorandom order and cut into blocks of
``length`` tokens; the last block of a source can be shorter. The mixture is a number of
slots, one block each. How many slots a source gets follows from its target share; where a
source is too small, even repeated as often as it may, the slots go to the others in
proportion. The slots of a source are drawn over the output shards multinomially, given
those totals, so that the shares hold exactly and each shard is a random sample: the shards are halved again
and again, each half draws its counts with a generator keyed by its place, so every task finds the counts of
its shards by itself and none holds the list of all. The i-th slot of
a source takes the block at place i of a pseudorandom permutation (a keyed Feistel network,
a new key for each repetition), and the blocks are joined by their index.

A block, hence each token of a document, is used at most max_repeats times. Sources without
target, null sources and documents with null or empty text take no part; a target whose
source is absent gets no slot and is reported with share 0. No source is ever held by one task: offsets are prefix
sums over hash buckets of at most about ``bucket_docs`` documents. The rank file of the tokenizer is sent with
the job, so only the driver needs its path; a missing file is an error before anything runs.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint, spread

#: Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Output shards at most, unless their size is given.
MOST_SHARDS = 10_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ENCODERS: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file, read once a process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = SparkFiles.get(os.path.basename(path))
        encode = encoder(sent if os.path.exists(sent) else path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def _send(spark: SparkSession, path: str) -> None:
    """Serve the rank file to all executors, those that join later included, once a session."""
    context = spark.sparkContext
    sent = getattr(context, "_pagemill_files", None)
    if sent is None:
        sent = context._pagemill_files = set()
    if path not in sent:
        if not os.path.exists(path):
            raise FileNotFoundError(f"no rank file of a tokenizer at {path}")
        context.addFile(path)
        sent.add(path)


def token_counts(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the documents of targeted sources that have a token."""
    _send(documents.sparkSession, path)
    wanted = targets.select("source").where(F.col("source").isNotNull()).distinct()
    d = documents.select("doc_id", "source", "text").where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull())
    return spread(d.join(F.broadcast(wanted), "source", "left_semi")).mapInArrow(_counter(path), "doc_id long, source string, tokens long")


def offsets(counts: DataFrame, bucket_docs: int = 100_000) -> DataFrame:
    """(doc_id, source, tokens, first): place of a document's first token in its source."""
    total = counts.count()
    buckets = max(1, math.ceil(total / bucket_docs))
    c = counts.withColumn("order", F.xxhash64("source", "doc_id", "tokens")).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = c.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"))  # sources x buckets rows
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "bucket", F.coalesce(F.sum("held").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = c.withColumn("within", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    return placed.join(base, ["source", "bucket"]).select("doc_id", "source", "tokens", (F.col("base") + F.col("within")).alias("first"))


def segments(placed: DataFrame, length: int) -> DataFrame:
    """(source, block, doc_id, from_token, to_token): which part of a document lies in which block."""
    last = F.col("first") + F.col("tokens") - 1
    blocks = F.sequence(F.floor(F.col("first") / length), F.floor(last / length))
    s = placed.select("source", "doc_id", "tokens", "first", F.explode(blocks).alias("block"))
    start, end = F.greatest(F.col("block") * length - F.col("first"), F.lit(0)), F.least((F.col("block") + 1) * length - F.col("first"), F.col("tokens"))
    return s.select("source", "block", "doc_id", start.alias("from_token"), end.alias("to_token"))


def quotas(held: dict[str, int], targets: dict[str, tuple[float, int]], length: int, slots: int | None) -> dict[str, tuple[int, int]]:
    """(blocks, slots) of every source: shares as near the targets as repeats allow."""
    blocks = {s: -(-held.get(s, 0) // length) for s in targets}
    most = {s: blocks[s] * max(0, cap) for s, (_, cap) in targets.items()}
    want = slots if slots is not None else sum(blocks.values())
    want = min(want, sum(most[s] for s, (share, _) in targets.items() if share > 0))
    open_ = {s for s, (share, _) in targets.items() if share > 0 and most[s] > 0}
    fixed: dict[str, float] = {}
    while open_:
        left = want - sum(fixed.values())
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if targets[s][0] / weight * left >= most[s]}
        if not full:
            fixed.update({s: targets[s][0] / weight * left for s in open_})
            break
        fixed.update({s: float(most[s]) for s in full})
        open_ -= full
    out = {s: int(math.floor(fixed.get(s, 0.0) + 1e-9)) for s in targets}
    rest = sorted(targets, key=lambda s: (-(fixed.get(s, 0.0) - out[s]), s))
    for s in rest:  # largest remainders
        if sum(out.values()) < want and out[s] < most[s] and fixed.get(s, 0.0) > out[s]:
            out[s] += 1
    return {s: (blocks[s], out[s]) for s in targets}


def _split(good: int, bad: int, n: int, r: np.random.Generator) -> int:
    """How many of n places drawn from good + bad fall on the good ones: hypergeometric.

    From 10^9 places on numpy has no generator for it. Then it is the binomial of the rarest of the four margins
    where that is small beside 10^9, else the normal distribution of the same mean and variance, kept within its bounds.
    """
    all_ = good + bad
    if max(good, bad) < 1_000_000_000:
        return int(r.hypergeometric(good, bad, n)) if n and all_ else 0
    rare = 1_000_000
    if good <= rare:
        x = int(r.binomial(good, n / all_))
    elif bad <= rare:
        x = n - int(r.binomial(bad, n / all_))
    elif n <= rare:
        x = int(r.binomial(n, good / all_))
    elif all_ - n <= rare:
        x = good - int(r.binomial(all_ - n, good / all_))
    else:
        mean = n * (good / all_)
        x = round(mean + r.standard_normal() * math.sqrt(mean * (bad / all_) * ((all_ - n) / (all_ - 1))))
    return min(max(x, 0, n - bad), n, good)


def shards_of(quota: dict[str, tuple[int, int]], shard_slots: int) -> int:
    return -(-sum(q[1] for q in quota.values()) // shard_slots)


def shard_counts(quota: dict[str, tuple[int, int]], shard_slots: int, seed: int, shard: int) -> list[tuple[int, str, int, int, int, int]]:
    """(shard, source, first slot of the source, slots, first place in the shard, slots of the shard) of one shard, the same in every task."""
    names = sorted(s for s in quota if quota[s][1] > 0)
    counts = [quota[s][1] for s in names]
    total = sum(counts)
    first = [0] * len(names)
    low, high = 0, shards_of(quota, shard_slots)
    while high - low > 1:
        middle = (low + high) // 2
        rest = (middle - low) * shard_slots  # slots of the left half
        r = np.random.default_rng((seed, low, high))
        pool = sum(counts)
        left = []
        for c in counts:  # one source after the other, given what is left
            pool -= c
            left.append(_split(c, pool, rest, r))
            rest -= left[-1]
        if shard < middle:
            high, counts = middle, left
        else:
            low, first, counts = middle, [a + b for a, b in zip(first, left)], [a - b for a, b in zip(counts, left)]
    out, place = [], 0
    width = min(shard_slots, total - shard * shard_slots)
    for s, a, n in zip(names, first, counts):
        if n:
            out.append((shard, s, a, n, place, width))
            place += n
    return out


def draw(quota: dict[str, tuple[int, int]], shard_slots: int, seed: int) -> list[tuple[int, str, int, int, int, int]]:
    """The counts of all shards."""
    return [row for shard in range(shards_of(quota, shard_slots)) for row in shard_counts(quota, shard_slots, seed, shard)]


def permute(i: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Places of a pseudorandom permutation of 0..n-1, by a keyed Feistel network with cycle walking."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    key = key.astype(np.uint64)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        v, k = x[todo], key[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            h = (right + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (k + np.uint64(r)) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            left, right = right, left ^ (h & mask)
        x[todo] = left << np.uint64(half) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def _slots(quota: dict[str, tuple[int, int]], shard_slots: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (row for s in b.column("id").to_pylist() for row in shard_counts(quota, shard_slots, seed, s)):
                shard, source, first, n, place, width = row
                size = quota[source][0]
                code = int.from_bytes(source.encode()[-6:], "big") + 7919 * seed
                for at in range(0, n, 65536):
                    i = np.arange(first + at, first + min(n, at + 65536), dtype=np.int64)
                    turn = i // size
                    block = permute(i % size, size, turn * 1_000_003 + code)
                    slot = permute(place + i - first, width, np.full(len(i), shard * 31 + seed))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), shard), pa.int64()), pa.array(slot, pa.int64()), pa.array([source] * len(i), pa.string()), pa.array(block, pa.int64()), pa.array(turn, pa.int64())],
                        ["shard", "slot", "source", "block", "turn"],
                    )

    return run


def plan(documents: DataFrame, targets: DataFrame, length: int = 256, slots: int | None = None, shard_slots: int | None = None, seed: int = 1, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame, dict[str, tuple[int, int]]]:
    """Segments, slots and quotas of a mixture."""
    spark: SparkSession = documents.sparkSession
    counts = checkpoint(token_counts(documents, targets, path).where("tokens > 0"))
    wanted = {r[0]: (max(0.0, r[1] or 0.0), r[2] if r[2] is not None else 1) for r in targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).collect()}
    held = {r[0]: r[1] for r in counts.groupBy("source").agg(F.sum("tokens")).collect()}  # one row a target
    quota = quotas(held, wanted, length, slots)
    total = sum(q[1] for q in quota.values())
    width = shard_slots or max(4096, -(-total // MOST_SHARDS))
    shards = shards_of(quota, width)
    placed = offsets(counts)
    tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    slotted = spark.range(0, shards, 1, tasks).mapInArrow(_slots(quota, width, seed), "shard long, slot long, source string, block long, turn long")
    return segments(placed, length), slotted, quota


def mixture(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(shard, slot, source, block, turn, doc_id, from_token, to_token): what stands in every slot, joined by block index."""
    parts, slotted, _ = plan(documents, targets, **options)
    return slotted.join(parts, ["source", "block"]).select("shard", "slot", "source", "block", "turn", "doc_id", "from_token", "to_token")


def shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, actual_share, tokens, most_used, max_repeats): the report of a mixture."""
    parts, slotted, _ = plan(documents, targets, **options)
    uses = slotted.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
    sizes = parts.groupBy("source", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("size"))
    got = uses.join(sizes, ["source", "block"]).groupBy("source").agg(F.sum(F.col("uses") * F.col("size")).alias("tokens"), F.max("uses").alias("most_used"))
    total = got.agg(F.sum("tokens").alias("total"))
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return t.join(got, "source", "left").join(F.broadcast(total)).select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeats"
    )


def checked(documents: DataFrame, targets: DataFrame, length: int = 256, **options) -> DataFrame:
    """(source, max_repeats, uses_over_cap, foreign_parts, broken_parts, uneven_slots): what a mixture must hold, counted per target; all zero in a right one.

    A use over the cap is a token block in more than max_repeats slots; a foreign part is of another source's document; a broken one lies
    outside its document or is longer than a block; an uneven slot holds more than one block, or a block in two pieces that overlap.
    """
    mix = checkpoint(mixture(documents, targets, length=length, **options))
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    cap = F.coalesce("max_repeats", F.lit(1))
    uses = mix.groupBy("source", "block").agg(F.countDistinct("shard", "slot").alias("uses")).join(F.broadcast(t), "source").where(F.col("uses") > cap)
    own = documents.select("doc_id", F.col("source").alias("own"), F.length("text").alias("chars"))
    parts = mix.join(own, "doc_id", "left")
    wrong = parts.groupBy("source").agg(
        F.sum((~F.col("source").eqNullSafe(F.col("own"))).cast("long")).alias("foreign_parts"),
        F.sum(((F.col("from_token") < 0) | (F.col("to_token") <= F.col("from_token")) | (F.col("to_token") - F.col("from_token") > length) | (F.col("to_token") > 4 * F.col("chars"))).cast("long")).alias("broken_parts"),
    )
    slots = mix.groupBy("source", "shard", "slot").agg(F.countDistinct("block").alias("blocks"), F.sum(F.col("to_token") - F.col("from_token")).alias("size")).where((F.col("blocks") > 1) | (F.col("size") > length))
    over, uneven = (x.groupBy("source").agg(F.count(F.lit(1)).alias(n)) for x, n in ((uses, "uses_over_cap"), (slots, "uneven_slots")))
    out = t.join(over, "source", "left").join(wrong, "source", "left").join(uneven, "source", "left")
    return out.select("source", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("uses_over_cap", "foreign_parts", "broken_parts", "uneven_slots")))
