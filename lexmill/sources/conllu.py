"""CoNLL-U text as token rows, in two views of one reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, sent_id, at, c): the columns c of every line that is not a comment, by blocks between empty lines."""
    blocks = files.select("file", F.posexplode(F.split(F.regexp_replace(text, "\r", ""), r"\n[ \t]*\n+")).alias("sent_id", "block"))
    rows = blocks.select("file", "sent_id", F.posexplode(F.split("block", "\n")).alias("at", "line"))
    rows = rows.filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    return rows.select("file", "sent_id", "at", F.split("line", "\t").alias("c"))


def for_parser(files: DataFrame) -> DataFrame:
    """(file, sent_id, id, form, upos, head, deprel): lines of eight columns or more with a plain number as id; head _ is -1."""
    rows = lines(files).filter((F.size("c") >= 8) & F.get("c", 0).rlike("^[0-9]+$"))
    head = F.when(F.get("c", 6).rlike("^[0-9]+$"), F.get("c", 6).cast("int")).otherwise(F.lit(-1))
    return rows.select("file", "sent_id", F.get("c", 0).cast("int").alias("id"), F.get("c", 1).alias("form"), F.get("c", 3).alias("upos"), head.alias("head"), F.get("c", 7).alias("deprel"))


def for_tagger(files: DataFrame, least: int = 2) -> DataFrame:
    """(file, sent_id, at, word, upos, feats): lower-cased words of letters and digits, without ranges and empty nodes, of sentences of ``least`` words or more."""
    rows = lines(files).filter((F.size("c") >= 6) & ~F.get("c", 0).rlike("[-.]"))
    rows = rows.select("file", "sent_id", "at", F.lower(F.get("c", 1)).alias("word"), F.get("c", 3).alias("upos"), F.get("c", 5).alias("feats")).filter(F.col("word").rlike(r"^[\p{L}\p{N}]+$"))
    enough = rows.groupBy("file", "sent_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return rows.join(enough, ["file", "sent_id"], "left_semi")
