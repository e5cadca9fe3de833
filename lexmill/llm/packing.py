"""Packing of token sequences by exact-complement hashing, then best fit.

1. One pass encodes the texts and cuts long ones into pieces; a piece knows its
   length and its running number among the pieces of that length in its partition.
   The narrow piece table goes to the shared scratch folder.
2. Counts by length, at most ``capacity`` of them, come to the driver, which plans in
   counts: a pattern is a multiset of lengths with a multiplicity. Gaps are filled
   exactly by one, two or three lengths, found in indexes of their sums and consumed
   under the counts; what is left goes by best fit, the longest first, over bins
   grouped by their gaps. Plan and time depend on the capacity, not on the rows.
3. A plan gives each length ranges of ranks with a sequence and an offset. The rank of
   a piece is its running number plus the counts of its length in earlier partitions;
   the ranges, some thousands at most, are looked up by binary search.

No group is gathered anywhere: a length that holds a third of all pieces is a number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.llm import bpe
from lexmill.llm.tokenizer import TOKENIZER, tokenizer_path
from lexmill.session import materialise, small_batches
from lexmill.sources.tables import table

CAPACITY = 2048
END_ID = 0

Pattern = tuple[tuple[int, ...], int]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole, or full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


class _Sums:
    """Available lengths with indexes of the sums of one, two and three of them."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.stale = True

    def _pairs(self) -> np.ndarray:
        if self.stale:
            have = (self.counts > 0).astype(float)
            size = 1 << (2 * len(have) - 1).bit_length()
            spectrum = np.fft.rfft(have, size)
            self.pairs = np.rint(np.fft.irfft(spectrum * spectrum, size)[: len(have)]) > 0
            self.stale = False
        return self.pairs

    def _enough(self, parts: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= parts.count(x) for x in parts)

    def pair(self, total: int) -> tuple[int, ...] | None:
        a = np.arange((total + 1) // 2, total)
        fits = (self.counts[a] > 0) & (self.counts[total - a] > 0)
        for x in a[fits][::-1].tolist():
            if self._enough((x, total - x)):
                return x, total - x
        return None

    def find(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to the gap; the longest parts first."""
        if gap <= 0:
            return None
        if self.counts[gap] > 0:
            return (gap,)
        if self._pairs()[gap] and (found := self.pair(gap)):
            return found
        a = np.arange(1, gap)
        for x in a[(self.counts[a] > 0) & self._pairs()[gap - a]][::-1].tolist():
            self.counts[x] -= 1
            found = self.pair(gap - x)
            self.counts[x] += 1
            if found and self._enough((x, *found)):
                return x, *found
        return None

    def take(self, parts: tuple[int, ...], most: int) -> int:
        """Uses the parts as often as counts allow, at most so often; tells how often."""
        n = min(most, *(int(self.counts[x]) // parts.count(x) for x in parts))
        for x in parts:
            self.counts[x] -= n
            self.stale |= self.counts[x] == 0
        return n


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (lengths of one sequence, how many such sequences) that use up the given counts by length."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        counts[length] += n
    out: list[Pattern] = []
    if counts[capacity]:
        out.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    sums = _Sums(counts)
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1  # so that its own complement leaves one for it
            found = sums.find(capacity - length)
            counts[length] += 1
            if not found:
                break
            n = sums.take((length, *found), 1 << 62)
            out.append(((length, *found), n))
    bins: dict[int, list[Pattern]] = defaultdict(list)
    for length in range(capacity - 1, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g, held in bins.items() if g >= length and held), default=0)
            if not gap:
                each = capacity // length
                full, rest = divmod(left, each)
                for times, n in ((each, full), (rest, 1)):
                    if times and n:
                        bins[capacity - times * length].append(((length,) * times, n))
                break
            parts, n = bins[gap].pop()
            used = min(left, n)
            if n > used:
                bins[gap].append((parts, n - used))
            bins[gap - length].append(((*parts, length), used))
            left -= used
    return out + [p for held in bins.values() for p in held]


def ranges(patterns: list[Pattern], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), first ranks, first sequence numbers and offsets."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for parts, n in patterns:
        offset = 0
        for length in parts:
            rows.append((length << 40 | rank[length], rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    rows.sort()
    held = np.array(rows, np.int64).reshape(-1, 4)
    return held[:, 0].copy(), held[:, 1].copy(), held[:, 2].copy(), held[:, 3].copy()


def pieces(docs: DataFrame, capacity: int, tokenizer: str, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, its partition and its number among that partition's pieces of this length."""
    fields = [("doc_id", docs.schema[id_col].dataType), ("piece", T.IntegerType())]
    fields += [(x, T.LongType()) for x in ("start", "length", "ids_crc32", "part", "nth")] + [("ids", T.BinaryType())] * keep_ids
    schema = T.StructType([T.StructField(*x) for x in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.automaton(tokenizer_path(tokenizer))
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            source, rows = [], []
            for i, ids in enumerate(coder.encode_all([x or "" for x in batch.column(1).to_pylist()])):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    source.append(i)
                    rows.append((k, start, length, bpe.crc(own), part, seen[length], own if keep_ids else None))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int32()] + [pa.int64()] * 5 + [pa.binary()] * keep_ids
            owner = batch.column(0).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids (binary) with keep_ids.

    Every text's ids are followed by END_ID. A null or empty text is one piece of
    length 1. Null ids and repeated rows are packed like any other, each row on its
    own. Other columns are not read and may have any name. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    held = materialise(pieces(docs, capacity, tokenizer, keep_ids, id_col, text_col), "pieces")
    by_part = materialise(held.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    lengths = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    keys, ranks, sequences, offsets = ranges(plan(lengths, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = held.join(starts, ["part", "length"])
    out = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = ranked.select(*out, (F.col("nth") + F.col("earlier")).alias("rank"))
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], schema.fieldNames())

    return ranked.mapInArrow(place, schema).withColumnRenamed("doc_id", id_col)


def op9_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_exact_complement_packing": op9_exact_complement_packing}
#: Encoding and planning are not SQL; the query is tested for whole and gapless sequences against the tokenizers library.
ORACLES: dict[str, str] = {}
