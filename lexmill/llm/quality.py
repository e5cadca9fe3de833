"""Quality rules from compression bands.

zstandard at a fixed level is run over the whole text and over fixed chunks of its
UTF-8 bytes. A ratio (compressed over raw bytes) under the band of its length says
repetitive, one over it says incompressible. Limits depend on length, since short
inputs compress worse; the lower ones are fitted by fit_bands() to texts labelled good.
Rows are judged alone, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.session import small_batches
from lexmill.sources.tables import table

LEVEL = 3
CHUNK = 4096
#: (bytes from, lowest ratio, highest ratio) of whole texts; shorter texts than the first have no band. The lowest are what fit_bands() gives on sf0.1.
TEXT_BANDS = ((256, 0.546, 0.80), (512, 0.514, 0.75), (1024, 0.454, 0.70), (4096, 0.416, 0.65), (16384, 0.403, 0.60), (131072, 0.37, 0.60))
#: The same of single chunks of CHUNK bytes; a last, shorter chunk is judged by the whole text's band for its length.
CHUNK_BAND = (0.446, 0.68)
#: Labelled rows that a fit reads at most, the share of texts labelled good that it lets fall out, and the fewest of a length that it fits.
LABELLED, LOST, LEAST = 20_000, 0.002, 10
#: A text fails if more than this share of its chunks is out of band.
BAD_CHUNKS = 0.25
#: Base rules: the fewest words, and the largest percentage of words in repeated windows of three.
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("low_chunks", T.LongType()),
        T.StructField("high_chunks", T.LongType()),
        T.StructField("verdict", T.StringType()),
    ]
)


def repeat_words(words: list) -> int:
    """How many words lie in a window of three words that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)[1]
    _, place, counts = np.unique(pairs[:-1] * np.int64(len(ids)) + codes[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[place] > 1)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text and its UTF-8 bytes."""
    words = raw.split()
    seen: set = set()
    dups = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dups += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dups, repeat_words(words)


def band_of(size: int) -> tuple[float, float]:
    """Lowest and highest ratio for a text of that many bytes."""
    low, high = 0.0, float("inf")
    for start, a, b in TEXT_BANDS:
        if size >= start:
            low, high = a, b
    return low, high


def compression(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, str]:
    """Ratio of the whole text, chunks under and over their band, and the verdict: ok, repetitive or incompressible."""
    if not raw:
        return 0.0, 0, 0, "ok"
    ratio = len(packer.compress(raw)) / len(raw)
    low = high = n = 0
    if len(raw) > CHUNK:
        view = memoryview(raw)
        for i in range(0, len(raw), CHUNK):
            part = view[i : i + CHUNK]
            a, b = CHUNK_BAND if len(part) == CHUNK else band_of(len(part))
            r = len(packer.compress(part)) / len(part)
            low, high, n = low + (r < a), high + (r > b), n + 1
    a, b = band_of(len(raw))
    if ratio < a or low > BAD_CHUNKS * n:
        return ratio, low, high, "repetitive"
    if ratio > b or high > BAD_CHUNKS * n:
        return ratio, low, high, "incompressible"
    return ratio, low, high, "ok"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2 + [pa.string()]
    names = SCHEMA.fieldNames()
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            raw = text.encode()
            base = base_counts(text, raw)
            failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT * base[0]
            ratio, low, high, verdict = compression(raw, packer)
            rows.append((*base, failed, not failed and verdict == "ok", ratio, low, high, verdict))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 11
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with the base counts, base_failed, kept, the ratio, chunk counts and the verdict.

    A null or empty text has no words, so base_failed is true and kept false; its
    verdict is ok and its ratio 0. Null ids and repeated rows are judged like any
    other. Other columns are not read and may have any name. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return narrow.mapInArrow(_judge, SCHEMA)


def fit_bands(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[tuple[tuple[int, float, float], ...], tuple[float, float]]:
    """TEXT_BANDS and CHUNK_BAND with the lowest ratios anew: the LOST quantile of the texts labelled good that pass the base rules, by length.

    labels has doc_id and quality (1: good). It reads the LABELLED good ones of
    smallest id at most. A length with fewer than LEAST of them keeps its limit.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy("doc_id").limit(LABELLED)
    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").join(good, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                base = base_counts(text.as_py() or "", raw)
                if base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT * base[0]:
                    continue
                rows.append((max((b[0] for b in TEXT_BANDS if len(raw) >= b[0]), default=0), len(packer.compress(raw)) / len(raw)))
                parts = [raw[i : i + CHUNK] for i in range(0, len(raw) - CHUNK + 1, CHUNK)] if len(raw) > CHUNK else []
                rows += [(-1, len(packer.compress(p)) / CHUNK) for p in parts]
            columns = list(zip(*rows, strict=True)) if rows else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64())], ["band", "ratio"])

    fitted = {r.band: r.low for r in narrow.mapInArrow(run, "band long, ratio double").groupBy("band").agg(F.expr(f"percentile(ratio, {LOST})").alias("low"), F.count(F.lit(1)).alias("n")).collect() if r.n >= LEAST}
    return tuple((size, round(fitted.get(size, low), 3), high) for size, low, high in TEXT_BANDS), (round(fitted.get(-1, CHUNK_BAND[0]), 3), CHUNK_BAND[1])


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, in one pass over the batches."""
    at = docs.columns.index(text_col)
    id_at = docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(id_at), batch.column(at)], ["doc_id", "text"])
            for judged in _judge(iter([one])):
                yield batch.filter(judged.column(7))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op2_compression_bands": op2_compression_bands}
#: SQL engines have no zstandard function; the query is tested against a brute-force version.
ORACLES: dict[str, str] = {}
