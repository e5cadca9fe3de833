"""Second-order hidden Markov tagger: counts by Spark, decoding by a kernel over plain dictionaries."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import chunked as C
from lexmill.operators import ngrams as N
from lexmill.session import materialise

START, END = "<START>", "<END>"
A3, A2, A1, A0 = 0.65, 0.25, 0.09, 0.01
DELTA, FLOOR = 1e-4, 1e-15
SUFFIXES, SUFFIX_LEAST, SUFFIX_K, NO_SUFFIX = 4, 3, 0.1, 1e-3
BEAM = 80
#: States are compared by scores of so many digits; ties go to the first tag by name.
DIGITS = 9
#: The most rows of a model that are gathered for the kernel; larger models are refused.
MODEL_ROWS = 5_000_000
#: So many words are tagged at once.
CHUNK_WORDS = 100_000


def emission_counts(tagged: DataFrame) -> DataFrame:
    """(w, tag, c) of tokens (w, tag) or of sentences (ws, tags)."""
    if "tags" in tagged.columns:
        tagged = tagged.select(F.inline(F.arrays_zip("ws", "tags")).alias("w", "tag"))
    return tagged.groupBy("w", "tag").agg(F.count(F.lit(1)).alias("c"))


def suffix_counts(emit: DataFrame) -> DataFrame:
    """(s, tag, c) of word ends of one to four characters, from emission counts."""
    n = F.length("w")
    ends = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(SUFFIXES))), lambda k: F.col("w").substr(n - k + 1, k))
    return emit.filter(n > 0).select("tag", "c", F.explode(ends).alias("s")).groupBy("s", "tag").agg(F.sum("c").alias("c"))


def tag_sequences(tagged: DataFrame) -> DataFrame:
    """Arrays ``tags`` with two start tags and an end tag, of tokens (sent_id, idx, tag) or of sentences (tags)."""
    if "tags" not in tagged.columns:
        tagged = tagged.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", "tag"))).alias("t")).select(F.transform("t", lambda x: x["tag"]).alias("tags"))
    return tagged.select(F.concat(F.array(F.lit(START), F.lit(START)), "tags", F.array(F.lit(END))).alias("tags"))


def transition_table(tagged: DataFrame) -> DataFrame:
    """(t1, t2, t3, p) for all tags: there are few, so all triples are listed."""
    tri = materialise(N.count_runs(tag_sequences(tagged), F.col("tags"), 3), "tag-trigrams")  # the only pass over the sentences
    bi = N.all_pairs(tri, END)
    uni = N.last_words(tri, END).select(F.col("w").alias("tag"), F.col("c").alias("c1"))
    total = uni.agg(F.sum("c1").alias("n"), F.count(F.lit(1)).alias("k"))
    tags = uni.select("tag")
    first = tags.union(tags.sparkSession.createDataFrame([(START,)], "tag string"))
    last = tags.union(tags.sparkSession.createDataFrame([(END,)], "tag string"))
    grid = first.select(F.col("tag").alias("w1")).crossJoin(first.select(F.col("tag").alias("w2"))).crossJoin(last.select(F.col("tag").alias("w3"))).crossJoin(F.broadcast(total))
    joined = (
        grid.join(tri.withColumnRenamed("c", "c3"), ["w1", "w2", "w3"], "left").join(N.contexts(tri, "w1", "w2", name="n3"), ["w1", "w2"], "left")
        .join(bi.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("c").alias("c2")), ["w2", "w3"], "left")
        .join(N.contexts(bi, "w1", name="n2").withColumnRenamed("w1", "w2"), "w2", "left").join(uni.withColumnRenamed("tag", "w3"), "w3", "left")
    )
    share = lambda c, n: F.when(F.col(n) > 0, F.coalesce(F.col(c), F.lit(0)) / F.col(n)).otherwise(F.lit(0.0))
    p = share("c3", "n3") * A3 + share("c2", "n2") * A2 + F.coalesce("c1", F.lit(0)) / F.greatest("n", F.lit(1)) * A1 + F.lit(A0) / (F.col("k") + 1)
    return joined.select(F.col("w1").alias("t1"), F.col("w2").alias("t2"), F.col("w3").alias("t3"), F.greatest(p, F.lit(FLOOR)).alias("p"))


def emission_table(words: DataFrame, tagged: DataFrame) -> DataFrame:
    """(w, tag, p) of each distinct word with the tags it was seen with, or with all tags if it was not seen."""
    emit = materialise(emission_counts(tagged), "emissions")  # the only pass over the tokens; the rest is counted from it
    tags = emit.groupBy("tag").agg(F.sum("c").alias("n"))
    size = emit.select("w").distinct().agg(F.count(F.lit(1)).alias("v"))
    total = tags.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    asked = words.select("w").distinct()
    seen = asked.join(emit, "w").join(F.broadcast(tags), "tag").join(F.broadcast(size))
    seen = seen.select("w", "tag", ((F.col("c") + DELTA) / (F.col("n") + (F.col("v") + 1) * F.lit(DELTA))).alias("p"))
    ends = suffix_counts(emit)
    sums = ends.groupBy("s").agg(F.sum("c").alias("all")).filter(F.col("all") >= SUFFIX_LEAST)
    new = asked.join(emit.select("w").distinct(), "w", "left_anti")
    n = F.length("w")
    tried = new.select("w", F.explode(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(SUFFIXES))), lambda k: F.col("w").substr(n - k + 1, k))).alias("s"))
    best = tried.join(sums, "s").groupBy("w").agg(F.max_by("s", F.length("s")).alias("s"), F.max_by("all", F.length("s")).alias("all"))
    grid = new.join(best, "w", "left").crossJoin(F.broadcast(tags)).join(F.broadcast(total)).join(ends, ["s", "tag"], "left")
    prior = (F.col("n") + 1) / (F.col("total") + F.col("k"))
    p = F.when(F.col("s").isNotNull(), (F.coalesce("c", F.lit(0)) + F.lit(SUFFIX_K)) / (F.col("all") + F.col("k") * F.lit(SUFFIX_K)) * prior).otherwise(prior * NO_SUFFIX)
    return seen.unionByName(grid.select("w", "tag", p.alias("p")))


def most_frequent_tags(tagged: DataFrame) -> DataFrame:
    """(w, tag): the tag seen most often with each word, the first by name among equals."""
    return emission_counts(tagged).groupBy("w").agg(F.min(F.struct((-F.col("c")).alias("n"), "tag")).alias("b")).select("w", "b.tag")


def tag_most_frequent(tokens: DataFrame, tagged: DataFrame) -> DataFrame:
    """tokens with the column pred: the word's most frequent tag, or the most frequent of all for new words."""
    emit = emission_counts(tagged)
    default = emit.groupBy("tag").agg(F.sum("c").alias("c")).agg(F.min(F.struct((-F.col("c")).alias("n"), "tag")).alias("b")).select(F.col("b.tag").alias("__d"))
    joined = tokens.join(most_frequent_tags(tagged).withColumnRenamed("tag", "__t"), "w", "left").crossJoin(F.broadcast(default))
    return joined.withColumn("pred", F.coalesce("__t", "__d")).drop("__t", "__d")


@dataclass
class Tagger:
    """The kernel's tables: log2 transitions by (t1, t2), and what emissions need."""

    tags: list[str]
    moves: dict[tuple[str, str], dict[str, float]]
    emit: dict[str, dict[str, int]]
    tag_n: dict[str, int]
    ends: dict[str, dict[str, int]]
    memo: dict[str, list[tuple[str, float]]] = field(default_factory=dict)

    def emissions(self, word: str) -> list[tuple[str, float]]:
        known = self.memo.get(word)
        if known is None:
            total, k = sum(self.tag_n.values()), len(self.tags)
            if word in self.emit:
                v = len(self.emit)
                p = {t: (c + DELTA) / (self.tag_n[t] + DELTA * (v + 1)) for t, c in self.emit[word].items()}
            else:
                prior = {t: (self.tag_n[t] + 1) / (total + k) for t in self.tags}
                end = next((e for n in range(min(SUFFIXES, len(word)), 0, -1) if sum((e := self.ends.get(word[-n:], {})).values()) >= SUFFIX_LEAST), None)
                p = {t: (end.get(t, 0) + SUFFIX_K) / (sum(end.values()) + SUFFIX_K * k) * prior[t] if end else prior[t] * NO_SUFFIX for t in self.tags}
            known = sorted((t, math.log2(max(x, FLOOR))) for t, x in p.items())
            if len(self.memo) < 200_000:
                self.memo[word] = known
        return known

    def tag(self, words: list[str]) -> list[str]:
        """The likeliest tags; [] for no words."""
        return self.decode([self.emissions(w) for w in words]) if self.tags else []

    def decode(self, options: list[list[tuple[str, float]]]) -> list[str]:
        """The likeliest tags of words given by their tags, in order, and log2 emissions; [] for no words."""
        if not options:
            return []
        states: dict[tuple[str, str], tuple[float, tuple]] = {(START, START): (0.0, ())}
        for option in options:
            new: dict[tuple[str, str], tuple[float, tuple]] = {}
            for (t1, t2), (score, path) in sorted(states.items()):
                moves = self.moves[t1, t2]
                for t3, e in option:
                    s = round(score + moves[t3] + e, DIGITS)
                    old = new.get((t2, t3))
                    if old is None or s > old[0]:
                        new[t2, t3] = (s, (path, t3))
            if len(new) > BEAM:
                new = dict(sorted(new.items(), key=lambda x: (-x[1][0], x[0]))[:BEAM])
            states = new
        best = min(states.items(), key=lambda x: (-round(x[1][0] + self.moves[x[0]][END], DIGITS), x[0]))
        out, path = [], best[1][1]
        while path:
            path, t = path
            out.append(t)
        return out[::-1]


def _rows(frame: DataFrame, what: str) -> list:
    rows = frame.limit(MODEL_ROWS + 1).collect()
    if len(rows) > MODEL_ROWS:
        raise ValueError(f"{what} has more than {MODEL_ROWS} rows; train on fewer sentences")
    return rows


def _moves(tagged: DataFrame) -> dict[tuple[str, str], dict[str, float]]:
    """log2 transitions by (t1, t2): as many as tags to the third power, whatever the data."""
    moves: dict[tuple[str, str], dict[str, float]] = {}
    for t1, t2, t3, p in transition_table(tagged).collect():
        moves.setdefault((t1, t2), {})[t3] = math.log2(p)
    return moves


def tagger(tagged: DataFrame) -> Tagger:
    """The kernel of a small model, whole; its tables are gathered up to MODEL_ROWS rows each. tag_sentences gathers transitions only."""
    emit: dict[str, dict[str, int]] = {}
    ends: dict[str, dict[str, int]] = {}
    tag_n: dict[str, int] = {}
    counts = emission_counts(tagged)
    for w, t, c in _rows(counts, "the word-tag table"):
        emit.setdefault(w, {})[t] = c
        tag_n[t] = tag_n.get(t, 0) + c
    for s, t, c in _rows(suffix_counts(counts), "the suffix table"):
        ends.setdefault(s, {})[t] = c
    return Tagger(sorted(tag_n), _moves(tagged), emit, tag_n, ends)


def tag_sentences(sentences: DataFrame, words: str, tagged: DataFrame, key: str = "sent_id") -> DataFrame:
    """sentences with an array column ``pred`` of tags for an array column of words, none for null; tagged: tokens or sentences to train on.

    Each chunk of sentences gets the emissions of its own words, so that of the model only
    the transitions are gathered.
    """
    n = F.greatest(F.coalesce(F.size(words), F.lit(0)), F.lit(1))
    held = C.deal(sentences, key, n, CHUNK_WORDS, "to-tag")
    asked = held.select(F.col(C.CHUNK).alias(C.ASKED_BY), F.explode(words).alias("w")).distinct()
    model = asked.join(emission_table(asked, tagged), "w").select(C.ASKED_BY, "w", "tag", "p")
    kernel = Tagger([], _moves(tagged), {}, {}, {})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        options: dict[str, list[tuple[str, float]]] = {}
        for w, t, p in zip(*(right[c].to_pylist() for c in ("w", "tag", "p")), strict=True):
            options.setdefault(w, []).append((t, math.log2(max(p, FLOOR))))
        for o in options.values():
            o.sort()
        tags = [kernel.decode([options[w] for w in ws]) if ws and options else [] for ws in left[words].to_pylist()]
        return left.append_column("pred", pa.array(tags, pa.list_(pa.string())))

    return C.apply(held, model, run, sentences.withColumn("pred", F.array(F.lit(""))).schema)


def log2(x: Column) -> Column:
    return F.log2(x)
