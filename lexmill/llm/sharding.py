"""Reproducible shuffling and sharding by a Feistel permutation of global row numbers.

Rows get the global numbers 0 .. N-1 in the order of (doc_id, crc32, size). A
Feistel network over the smallest power-of-two domain that holds N, walked along
its cycles until the result is below N, permutes 0 .. N-1. The image p of a row
fixes its place: shard p mod S, slot p div S. So shard counts differ by one at
most (the law ``rows``), slots are gapless, and anyone who knows N, S and the
seed can compute where row i went, or which row stands at a place, without data.

Everything is DataFrame functions. The only global step is a range-partitioned
sort of narrow rows (id, size, checksum); a tie-breaker splits even equal rows
over partitions. Per-partition counts, one row for each partition, are summed
to offsets and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.session import materialise
from lexmill.sources.tables import table

ROUNDS = 6
#: Steps of a cycle walk. Each leaves the domain with a chance under 1/2, so none gets near; one that did would stop the job.
WALK = 64


def _round(x: Column, seed: int, i: int) -> Column:
    """A pseudo-random long from half of a number; x stands in it once, which keeps nested rounds small."""
    return F.xxhash64(x, F.lit(i), F.lit(seed))


def feistel(x: Column, bits: int, seed: int, rounds: int = ROUNDS) -> Column:
    """Permutes 0 .. 2^bits - 1 (2 <= bits <= 60) by an even number of Feistel rounds."""
    high, low = bits // 2, bits - bits // 2
    left, right = F.shiftright(x, low), x.bitwiseAND(F.lit((1 << low) - 1))
    wide = low, high
    for i in range(rounds):
        mixed = left.bitwiseXOR(_round(right, seed, i).bitwiseAND(F.lit((1 << (high if i % 2 == 0 else low)) - 1)))
        left, right = right, mixed
    return left * F.lit(1 << wide[0]) + right


def permuted(row: Column, n: int, seed: int) -> Column:
    """The place of row number ``row`` in a permutation of 0 .. n-1, by cycle walking."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    once = feistel(row, bits, seed)
    end = F.lit(max(n, 1))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        once,
        lambda at, _: F.when(at < end, at).otherwise(feistel(at, bits, seed)),
    )
    return F.when(walked < end, walked).otherwise(F.raise_error(F.lit("a cycle walk did not end; take another seed")).cast("long"))


def number_rows(df: DataFrame, order: list[str], name: str = "numbered") -> tuple[DataFrame, int]:
    """df with gapless long column ``row`` from 0 in the given order, and the row count.

    Nulls come first. Equal rows get neighbouring numbers in any order. The sorted
    rows are written to the shared scratch folder, so that both later passes see the
    same partitions after an executor is lost.
    """
    kept = df.columns
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    ordered = tied.orderBy(*order, "__tie").drop("__tie")
    fixed = materialise(ordered.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = materialise(fixed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")), f"{name}-counts")
    n = counts.agg(F.sum("__n")).first()[0] or 0
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    joined = fixed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    row = F.col("__from") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*kept, row.alias("row")), n


def shard(docs: DataFrame, shards: int = 16, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard, row.

    A null text has size 1 and the checksum of no bytes; an empty one too. Null ids
    count as the smallest id. Repeated rows each get a place of their own; which of
    two equal rows gets which is not told apart by any returned column. Only id and
    text are read, so that other columns may have any name. No rows: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, n = number_rows(narrow, ["doc_id", "text_crc32", "size"], "shard")
    place = rows.withColumn("__p", permuted(F.col("row"), n, seed))
    return place.select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("__p") % shards).cast("int").alias("shard"),
        F.floor(F.col("__p") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        "row",
    )


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=16)


QUERIES = {"op8_feistel_shards": op8_feistel_shards}
#: DuckDB has no CRC-32; the query is tested against a brute-force version.
ORACLES: dict[str, str] = {}
