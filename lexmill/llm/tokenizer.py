"""BPE encoding and decoding of text columns by the tokenization automaton of bpe.py.

One pass over Arrow batches, nothing shuffled; the automaton is compiled once in each
Python worker. Memory is the batch, the automaton and the bounded table of words.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexmill.llm import bpe
from lexmill.session import small_batches
from lexmill.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name among the public tokenizer files, looked up where this runs."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def round_trip(
    docs: DataFrame, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes every text and decodes its ids again: id, n_tokens, ids_sha256, decoded_sha256, and what keep names.

    keep may name ``ids`` (binary, little-endian unsigned 32-bit integers) and
    ``decoded`` (string). A null or empty text has no ids and decodes to an empty
    text. Null ids and repeated rows are kept as they are; other columns are not read
    and may have any name. No rows: no rows.
    """
    fields = [("doc_id", docs.schema[id_col].dataType), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    kinds = {"ids": (T.BinaryType(), pa.binary()), "decoded": (T.StringType(), pa.string())}
    fields += [(x, kinds[x][0]) for x in keep]
    schema = T.StructType([T.StructField(*x) for x in fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.automaton(tokenizer_path(tokenizer))
        for batch in batches:
            counts, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for ids in coder.encode_all([x or "" for x in batch.column(1).to_pylist()]):
                decoded = coder.decode(ids)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if "ids" in keep:
                    all_ids.append(ids)
                if "decoded" in keep:
                    all_text.append(decoded)
            held = {"ids": all_ids, "decoded": all_text}
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(held[x], kinds[x][1]) for x in keep], names)

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def decode(frame: DataFrame, tokenizer: str = TOKENIZER, ids_col: str = "ids") -> DataFrame:
    """frame with a string column ``decoded`` of its binary ids; null ids give an empty text."""
    schema = T.StructType([*frame.drop("decoded").schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.automaton(tokenizer_path(tokenizer))
        for batch in batches:
            texts = [coder.decode(x.as_py() or b"") for x in batch.column(batch.schema.get_field_index(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.fieldNames())

    return frame.drop("decoded").mapInArrow(run, schema)


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), keep=())


QUERIES = {"op5_bpe_automaton": op5_bpe_automaton}
#: Merges in order are not SQL; the query is tested against the tokenizers library and by exact round trips.
ORACLES: dict[str, str] = {}
