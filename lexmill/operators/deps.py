"""Transition-based dependency parsing: a static oracle, a softmax over four tags, a greedy parser."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SHIFT, LEFT, RIGHT = "SHIFT", "LEFT-ARC", "RIGHT-ARC"
ROOT_TAG, NO_TAG = "<ROOT>", "<NULL>"
C, STEPS = 1.0, 60


class Configuration:
    """Stack and next place of the buffer; tokens are 1 .. n, 0 is the root."""

    def __init__(self, n: int) -> None:
        self.n, self.stack, self.next = n, [0], 1
        self.arcs: list[tuple[int, int, str]] = []

    @property
    def done(self) -> bool:
        return self.next > self.n and len(self.stack) == 1

    def legal(self) -> list[str]:
        """The transitions that apply here; the root never becomes a dependent."""
        out = [LEFT] if len(self.stack) >= 2 and self.stack[-2] != 0 else []
        return out + [RIGHT] * (len(self.stack) >= 2) + [SHIFT] * (self.next <= self.n)

    def apply(self, move: str, label: str | None) -> None:
        if move not in self.legal():
            raise ValueError(f"{move} does not apply")
        if move == SHIFT:
            self.stack.append(self.next)
            self.next += 1
            return
        at = -2 if move == LEFT else -1
        dep = self.stack.pop(at)
        head = self.stack[-1]
        self.arcs.append((head, dep, label or "dep"))

    def features(self, tags: list[str]) -> tuple[str, str, str, str]:
        """Tags of the two top stack tokens and the two next buffer tokens."""
        def stack(k: int) -> str:
            if len(self.stack) < k:
                return NO_TAG
            return tags[self.stack[-k] - 1] if self.stack[-k] else ROOT_TAG

        def ahead(k: int) -> str:
            return tags[self.next + k - 1] if self.next + k <= self.n else NO_TAG

        return stack(1), stack(2), ahead(0), ahead(1)


def oracle(heads: list[int], labels: list[str], tags: list[str]) -> list[tuple[tuple[str, str, str, str], str, str | None]] | None:
    """(features, transition, label) of each step to the gold tree; None if no sequence of steps builds it."""
    n = len(heads)
    waiting = [0] * (n + 1)
    for h in heads:
        if 0 <= h <= n:
            waiting[h] += 1
    at, steps = Configuration(n), []
    while not at.done:
        move, dep = None, 0
        if len(at.stack) >= 2:
            top, under = at.stack[-1], at.stack[-2]
            if under and heads[under - 1] == top:
                move, dep = LEFT, under
            elif top and heads[top - 1] == under and not waiting[top]:
                move, dep = RIGHT, top
        if move is None:
            if at.next > n:
                return None
            move = SHIFT
        label = labels[dep - 1] if dep else None
        steps.append((at.features(tags), move, label))
        at.apply(move, label)
        if dep:
            waiting[heads[dep - 1]] -= 1
    built = {d: h for h, d, _ in at.arcs}
    return steps if all(built.get(i + 1) == h for i, h in enumerate(heads)) else None


def encode_label(move: Column, label: Column) -> Column:
    return F.when(move == SHIFT, move).otherwise(F.concat_ws(":", move, label))


def decode_label(code: Column) -> tuple[Column, Column]:
    """Transition and label; the label may hold colons itself."""
    parts = F.split(code, ":", 2)
    return F.get(parts, 0), F.get(parts, 1)


def _walk(heads: list[int]) -> list[tuple[int, int, int, int]] | None:
    """(dependent, stack top, the one under it, next) of each step of oracle(), on plain numbers: the dependent is 0 for a shift, negative for a left arc; no token is -1, the root 0. None as for oracle()."""
    n = len(heads)
    waiting = [0] * (n + 1)
    for h in heads:
        if 0 <= h <= n:
            waiting[h] += 1
    stack, top, under, at, steps = [], 0, -1, 1, []  # stack holds what lies below under
    attached = 0
    while at <= n or under >= 0:
        if under > 0 and heads[under - 1] == top:
            steps.append((-under, top, under, at))
            waiting[top] -= 1
            attached += 1
            under = stack.pop() if stack else -1
        elif top > 0 and under >= 0 and heads[top - 1] == under and not waiting[top]:
            steps.append((top, top, under, at))
            waiting[under] -= 1
            attached += 1
            top, under = under, stack.pop() if stack else -1
        elif at > n:
            return None
        else:
            steps.append((0, top, under, at))
            if under >= 0:
                stack.append(under)
            top, under, at = at, top, at + 1
    return steps if attached == n else None


def step_counts(sentences: DataFrame) -> DataFrame:
    """(sent_id, steps, shifts, ok) of (sent_id, heads): steps to the tree, 0 and not ok for one that cannot be built."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walks = [_walk(h) for h in batch.column(1).to_pylist()]
            steps = [len(w or ()) for w in walks]
            shifts = [sum(not x[0] for x in w or ()) for w in walks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps, pa.int64()), pa.array(shifts, pa.int64()), pa.array([w is not None for w in walks], pa.bool_())], ["sent_id", "steps", "shifts", "ok"])

    return sentences.select(F.col("sent_id").cast("long"), "heads").mapInArrow(run, "sent_id long, steps long, shifts long, ok boolean")


def training_counts(sentences: DataFrame) -> DataFrame:
    """(s0, s1, b0, b1, code, n) over the oracle steps of all trees (heads, labels, tags) that can be built. Each task counts its own before they are added up."""
    names = ["s0", "s1", "b0", "b1", "move", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for heads, labels, tags in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                walk = _walk(heads)
                if walk:
                    # places 0 .. n + 2: the root, the tokens, none twice; so -1 is none, too
                    at, name = [ROOT_TAG, *tags, NO_TAG, NO_TAG], [None, *labels]
                    found.update([(at[s0], at[s1], at[b], at[b + 1], d, None) if not d else (at[s0], at[s1], at[b], at[b + 1], 1 if d > 0 else -1, name[abs(d)]) for d, s0, s1, b in walk])
        rows = [(*k[:4], (SHIFT, RIGHT, LEFT)[k[4]], k[5], c) for k, c in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:6]), pa.array(columns[6], pa.int64())], [*names, "n"])

    counted = sentences.select("heads", "labels", "tags").mapInArrow(run, ", ".join(f"{c} string" for c in names) + ", n long")
    return counted.select("s0", "s1", "b0", "b1", encode_label(F.col("move"), F.col("label")).alias("code"), "n").groupBy("s0", "s1", "b0", "b1", "code").agg(F.sum("n").alias("n"))


def crosses(arcs: Column) -> Column:
    """Whether two arcs of an array of (head, dep) cross. Arcs of neighbours cross nothing and are left out first."""
    far = F.filter(F.transform(arcs, lambda a: F.struct(F.least(a["head"], a["dep"]).alias("lo"), F.greatest(a["head"], a["dep"]).alias("hi"))), lambda a: a["hi"] - a["lo"] > 1)
    return F.exists(far, lambda a: F.exists(far, lambda b: (a["lo"] < b["lo"]) & (b["lo"] < a["hi"]) & (a["hi"] < b["hi"])))


def train(counts: DataFrame) -> tuple[object, list[str]]:
    """A multinomial softmax on one-hot tags from weighted counts, and the codes of its classes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    names = ["s0", "s1", "b0", "b1"]
    total = counts.agg(F.sum("n")).first()[0]
    label = StringIndexer(inputCol="code", outputCol="y", stringOrderType="alphabetAsc")
    index = StringIndexer(inputCols=names, outputCols=[f"{c}_i" for c in names], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in names], outputCols=[f"{c}_v" for c in names], dropLast=False)
    joined = VectorAssembler(inputCols=[f"{c}_v" for c in names], outputCol="x")
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="n", family="multinomial", regParam=1.0 / (C * total), elasticNetParam=0.0, standardization=False, maxIter=STEPS)
    held = counts.withColumn("n", F.col("n").cast("double")).coalesce(1)
    labels = label.fit(held)
    model = Pipeline(stages=[index, hot, joined, fit]).fit(labels.transform(held))
    return model, labels.labels


def ranking(model: object, codes: list[str], counts: DataFrame) -> dict[tuple[str, str, str, str], list[str]]:
    """For every combination of four known tags, the codes from the likeliest on. There are as many as tags to the fourth power, whatever the data."""
    from pyspark.ml.functions import vector_to_array

    tags = sorted({r[0] for c in ("s0", "s1", "b0", "b1") for r in counts.select(c).distinct().collect()} | {NO_TAG, ROOT_TAG})
    k = len(tags)
    # one range: joins of four small tables have as many tasks as the fourth power of their parts
    name = lambda power: F.get(F.array(*(F.lit(t) for t in tags)), F.pmod(F.floor(F.col("id") / k**power), F.lit(k)).cast("int"))
    grid = counts.sparkSession.range(k**4).select(*(name(3 - i).alias(c) for i, c in enumerate(("s0", "s1", "b0", "b1"))))
    scored = model.transform(grid).select("s0", "s1", "b0", "b1", vector_to_array("probability").alias("p"))
    return {tuple(r[:4]): [c for _, c in sorted((-round(p, 9), code) for p, code in zip(r[4], codes, strict=True))] for r in scored.collect()}


def parse(tags: list[str], ranks: dict[tuple[str, str, str, str], list[str]], memo: dict | None = None) -> list[tuple[int, int, str]]:
    """(head, dep, label) of each token, by dependent: the likeliest transition that applies, until all is read. memo: what was chosen before, by tags and what applies; for the same ranks."""
    n, memo = len(tags), {} if memo is None else memo
    at = [ROOT_TAG, *tags, NO_TAG, NO_TAG]
    default = next(iter(ranks.values()), [])
    arcs: list = [None] * (n + 1)
    stack, top, under, ahead = [], 0, -1, 1  # stack holds what lies below under
    for _ in range(4 * n + 5):
        if ahead > n and under < 0:
            break
        key = (at[top], at[under], at[ahead], at[ahead + 1], under > 0, under >= 0, ahead <= n)
        chosen = memo.get(key)
        if chosen is None:
            legal = [LEFT] * (under > 0) + [RIGHT] * (under >= 0) + [SHIFT] * (ahead <= n)
            chosen = (SHIFT, None) if SHIFT in legal else (RIGHT, "dep")
            for code in ranks.get(key[:4], default):
                name, _, rest = code.partition(":")
                if name in legal:
                    chosen = name, rest or None
                    break
            memo[key] = chosen
        move, label = chosen
        if move == SHIFT:
            if under >= 0:
                stack.append(under)
            top, under, ahead = ahead, top, ahead + 1
        elif move == LEFT:
            arcs[under] = (top, under, label or "dep")
            under = stack.pop() if stack else -1
        else:
            arcs[top] = (under, top, label or "dep")
            top, under = under, stack.pop() if stack else -1
    return [arcs[i] or (0, i, "dep") for i in range(1, n + 1)]


def parse_sentences(sentences: DataFrame, ranks: dict) -> DataFrame:
    """sentences with p_heads and p_labels, arrays as long as the column tags."""
    held = sentences.sparkSession.sparkContext.broadcast(ranks)
    columns = [*sentences.columns, "p_heads", "p_labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            parsed = [parse(tags, held.value, memo) for tags in batch.column(batch.schema.get_field_index("tags")).to_pylist()]
            heads = pa.array([[a[0] for a in p] for p in parsed], pa.list_(pa.int32()))
            labels = pa.array([[a[2] for a in p] for p in parsed], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, heads, labels], columns)

    schema = StructType([*sentences.schema.fields, StructField("p_heads", ArrayType(IntegerType())), StructField("p_labels", ArrayType(StringType()))])
    return sentences.mapInArrow(run, schema)
