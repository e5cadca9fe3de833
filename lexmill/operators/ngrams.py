"""n-gram count tables: explode the windows of each sentence, then count with map-side combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS = "<s>", "</s>"


def padded(ws: Column, starts: int = 2) -> Column:
    """A sentence with start marks before and an end mark after it."""
    return F.concat(F.array(*(F.lit(BOS) for _ in range(starts))), ws, F.array(F.lit(EOS)))


def runs(rows: DataFrame, words: Column, n: int, *keys: str) -> DataFrame:
    """(keys, w1 .. wn): all runs of n neighbours, one row each; none if there are fewer words. Arrays shifted against each other are zipped, for which Spark has compiled code."""
    held = rows.select(*keys, words.alias("__a"))
    size = F.greatest(F.size("__a") - (n - 1), F.lit(0))
    zipped = F.arrays_zip(*(F.slice("__a", k + 1, size) for k in range(n)))
    return held.select(*keys, F.inline(zipped).alias(*(f"w{k + 1}" for k in range(n))))


def count_runs(rows: DataFrame, words: Column, n: int, name: str = "c") -> DataFrame:
    """(w1 .. wn, c) over all rows."""
    found = runs(rows, words, n)
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias(name))


def unigrams(rows: DataFrame, words: Column) -> DataFrame:
    return rows.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))


def alpha_only(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))


def contexts(grams: DataFrame, *keys: str, name: str) -> DataFrame:
    """How often the first words of n-grams occur as such."""
    return grams.groupBy(*keys).agg(F.sum("c").alias(name))


def last_words(tri: DataFrame, end: str = EOS) -> DataFrame:
    """(w, c) of all words, from trigrams of sentences with both marks."""
    return tri.filter(F.col("w3") != end).groupBy(F.col("w3").alias("w")).agg(F.sum("c").alias("c"))


def all_pairs(tri: DataFrame, end: str = EOS) -> DataFrame:
    """(w1, w2, c) of all neighbours, that of the start marks included, from trigrams of sentences with both marks."""
    first = tri.select("w1", "w2", "c")
    last = tri.filter(F.col("w3") == end).select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "c")
    return first.unionByName(last).groupBy("w1", "w2").agg(F.sum("c").alias("c"))


def characters(counted: DataFrame, n: int) -> DataFrame:
    """(gram, c): runs of n characters of ^word$, for every occurrence of a word; counted: (w, c)."""
    marked = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
    grams = counted.select("c", F.explode(F.transform(starts, lambda i: marked.substr(i, F.lit(n)))).alias("gram"))
    return grams.filter(F.length("gram") == n).groupBy("gram").agg(F.sum("c").alias("c"))
