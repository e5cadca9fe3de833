"""Spelling correction within one edit, as joins.

Candidates come from an equi-join on deletion forms: two words are within one edit
only if they share a word or a one-character deletion. A check of the distance follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import strings as S
from lexmill.operators import ngrams as N
from lexmill.session import materialise

MARGIN = 1.5
#: Scores are rounded before they are compared, so that sums in another order tie.
DIGITS = 9


def vocabulary(rows: DataFrame, words: Column, least: int = 1) -> DataFrame:
    """(w, c): words of letters seen at least so often."""
    return N.unigrams(rows, N.alpha_only(words)).filter(F.col("c") >= least)


def deletes_index(vocab: DataFrame) -> DataFrame:
    """(form, words): each one-character deletion with the words that give it."""
    keyed = vocab.select("w", F.explode(S.deletes(F.col("w"))).alias("form"))
    return keyed.groupBy("form").agg(F.array_sort(F.collect_set("w")).alias("words"))


def _keys(frame: DataFrame, word: str) -> DataFrame:
    w = F.col(word)
    return frame.select(word, F.explode(F.array_distinct(F.concat(F.array(w), S.deletes(w)))).alias("form"))


def near_pairs(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct (q, w) that share a deletion form or are one; not yet checked."""
    pairs = _keys(queries.select("q").distinct(), "q").join(_keys(vocab.select("w"), "w"), "form")
    return pairs.filter("q <> w").select("q", "w").distinct()


def candidates(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(q, w): vocabulary words one edit away from each query."""
    return near_pairs(queries, vocab).filter(S.is_edit1(F.col("q"), F.col("w")))


def candidates_by_edits(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same for edits with a to z, by listing all edits."""
    listed = queries.select("q").distinct().select("q", F.explode(S.edits1(F.col("q"))).alias("w")).filter("q <> w")
    return listed.join(vocab.select("w"), "w", "left_semi").select("q", "w")


def correct_nonwords(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(q, fixed): the most frequent candidate, the first by name among equals; q itself without any."""
    asked = queries.select("q").distinct()
    best = candidates(asked, vocab).join(vocab, "w").groupBy("q").agg(F.min(F.struct((-F.col("c")).alias("n"), "w")).alias("b"))
    return asked.join(best, "q", "left").select("q", F.coalesce("b.w", "q").alias("fixed"))


def _log(frame: DataFrame, bi: DataFrame, ctx: DataFrame, first: str, second: str, size: int, name: str) -> DataFrame:
    """frame with ln of the add-one bigram probability; 0 where a word is missing."""
    counts = bi.select(F.col("w1").alias(first), F.col("w2").alias(second), F.col("c").alias("__c"))
    heads = ctx.select(F.col("w1").alias(first), F.col("n").alias("__n"))
    joined = frame.join(counts, [first, second], "left").join(heads, first, "left")
    p = (F.coalesce("__c", F.lit(0)) + 1) / (F.coalesce("__n", F.lit(0)) + F.lit(size))
    missing = F.col(first).isNull() | F.col(second).isNull()
    return joined.withColumn(name, F.when(missing, F.lit(0.0)).otherwise(F.ln(p))).drop("__c", "__n")


def correct_realwords(phrases: DataFrame, vocab: DataFrame, bi: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(prev, q, next, fixed) of distinct phrases: the candidate that fits best between its neighbours, if it beats q by more than the margin."""
    asked = phrases.select("prev", "q", "next").distinct()
    ctx, size = N.contexts(bi, "w1", name="n"), vocab.count()
    tried = asked.join(candidates(asked, vocab), "q").select("prev", "q", "next", "w")
    tried = tried.unionByName(asked.select("prev", "q", "next", F.col("q").alias("w")))
    scored = _log(_log(tried, bi, ctx, "prev", "w", size, "a"), bi, ctx, "w", "next", size, "b")
    scored = scored.withColumn("s", F.round(F.col("a") + F.col("b"), DIGITS))
    best = scored.groupBy("prev", "q", "next").agg(F.max(F.when(F.col("w") == F.col("q"), F.col("s"))).alias("own"), F.min(F.struct((-F.col("s")).alias("n"), F.when(F.col("w") == F.col("q"), "").otherwise(F.col("w")).alias("w"))).alias("b"))
    changed = (F.col("b.w") != "") & (F.round(-F.col("b.n") - F.col("own"), DIGITS) > margin)
    return best.select("prev", "q", "next", F.when(changed, F.col("b.w")).otherwise(F.col("q")).alias("fixed"))


def correct_sentences(sentences: DataFrame, key: list[str], vocab: DataFrame, bi: DataFrame) -> DataFrame:
    """(key, fixed): arrays ``tokens`` with words corrected by themselves or between their neighbours, as typed; other tokens stay."""
    rows = sentences.select(*key, F.posexplode("tokens").alias("i", "token"), "tokens")
    low = lambda c: F.when(c.rlike(r"^\p{L}+$"), F.lower(c))
    rows = rows.select(*key, "i", "token", low(F.col("token")).alias("q"), F.when(F.col("i") > 0, low(F.get("tokens", F.col("i") - 1))).alias("prev"), low(F.get("tokens", F.col("i") + 1)).alias("next"))
    known = vocab.select(F.col("w").alias("q"), F.lit(True).alias("known"))
    rows = materialise(rows.join(known, "q", "left"), "typed")
    unknown = correct_nonwords(rows.filter("known is null and q is not null"), vocab).withColumnRenamed("fixed", "fixed_n")
    phrases = correct_realwords(rows.filter("known"), vocab, bi).select(F.col("prev").alias("p"), F.col("q").alias("q2"), F.col("next").alias("x"), F.col("fixed").alias("fixed_r"))
    rows = rows.join(unknown, "q", "left").join(phrases, F.col("known") & F.col("q").eqNullSafe(F.col("q2")) & F.col("prev").eqNullSafe(F.col("p")) & F.col("next").eqNullSafe(F.col("x")), "left")
    fixed = F.coalesce(F.when(F.col("known"), F.col("fixed_r")).otherwise(F.col("fixed_n")), "q")
    word = F.when(F.col("q").isNull() | (fixed == F.col("q")), F.col("token")).otherwise(S.restore_case(F.col("token"), fixed))
    held = rows.select(*key, "i", word.alias("w"), (word != F.col("token")).cast("int").alias("d")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("t"), F.sum("d").cast("long").alias("n_changed"))
    return held.select(*key, F.transform("t", lambda x: x["w"]).alias("fixed"), "n_changed")


def test_cases(sentences: DataFrame, words: Column, vocab: DataFrame, attempts: int = 20, one_in: int = 10) -> DataFrame:
    """(kind, sent_id, tokens, i, original, typo): a word of each sampled sentence with an edit that gives a non-word, and one that gives another word."""
    s = sentences.select("sent_id", N.alpha_only(words).alias("tokens")).filter(F.size("tokens") >= 2)
    s = s.filter(S.hashed(F.concat(F.col("sent_id").cast("string"), F.lit(":s")), one_in) == 0)
    i = S.hashed(F.concat(F.col("sent_id").cast("string"), F.lit(":i")), F.size("tokens")).cast("int")
    s = materialise(s.withColumn("i", i).withColumn("original", F.get("tokens", F.col("i"))), "sampled")
    kinds = F.array(F.lit("nonword"), F.lit("realword"))
    tried = s.select("sent_id", "original", F.explode(kinds).alias("kind")).select("*", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("k"))
    seed = F.concat_ws(":", F.col("sent_id").cast("string"), "kind", F.col("k").cast("string"))
    tried = tried.withColumn("typo", S.random_edit(F.col("original"), seed)).filter("typo <> original")
    tried = tried.join(vocab.select(F.col("w").alias("typo"), F.lit(True).alias("known")), "typo", "left")
    first = tried.filter("(kind = 'nonword') = (known is null)").groupBy("kind", "sent_id").agg(F.min_by("typo", "k").alias("typo"))
    return first.join(s, "sent_id").select("kind", "sent_id", "tokens", "i", "original", "typo")


def speed_batch(vocab: DataFrame, n: int = 1000) -> DataFrame:
    """(k, original, typo): n words in md5 order, edited once."""
    picked = vocab.select("w", F.md5(F.col("w").cast("binary")).alias("m")).orderBy("m").limit(n)
    return picked.select(F.col("w").alias("original"), S.random_edit(F.col("w"), F.lit("batch")).alias("typo"))
