"""Word segmentation of text without spaces: greedy longest match, and beam search under the interpolated model."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.operators import chunked as C
from lexmill.operators import lm as M
from lexmill.operators import wordset as W
from lexmill.operators.hmm import _rows
from lexmill.operators.ngrams import BOS, EOS
from lexmill.session import materialise

LONGEST, BEAM, UNKNOWN_LONGEST, UNKNOWN_COST = 25, 40, 10, 2.0
#: The editor searches no longer texts.
SEARCH_LIMIT = 2000
#: So many characters are searched at once; the most bits that tell which pairs were seen (64 MB), in blocks. With fewer bits than pairs, more pairs are asked for in vain.
CHUNK_CHARS, PAIR_BITS, BLOCK = 100_000, 1 << 29, 1 << 16


def greedy(text: str, vocab: Container[str], longest: int = LONGEST) -> list[str]:
    """The longest known word at each place, or one character."""
    text, out, at = text.strip().lower(), [], 0
    while at < len(text):
        size = next((n for n in range(min(longest, len(text) - at), 1, -1) if text[at : at + n] in vocab), 1)
        out.append(text[at : at + size])
        at += size
    return out


@dataclass
class Model:
    """The interpolated model as dictionaries."""

    uni: dict[str, int]
    bi: dict[tuple[str, str], int]
    tri: dict[tuple[str, str, str], int]
    ch2: dict[str, int]
    ch3: dict[str, int]
    total: int
    chars: int
    ctx1: dict[str, int] = field(default_factory=dict)
    ctx2: dict[tuple[str, str], int] = field(default_factory=dict)
    memo: dict[str, float] = field(default_factory=dict)
    #: Whether contexts are to be counted from pairs and triples; a part of a model comes with them.
    whole: bool = True

    def __post_init__(self) -> None:
        if not self.whole:
            return
        for (a, _), c in self.bi.items():
            self.ctx1[a] = self.ctx1.get(a, 0) + c
        for (a, b, _), c in self.tri.items():
            self.ctx2[a, b] = self.ctx2.get((a, b), 0) + c

    def after(self) -> tuple[dict[str, dict[str, int]], dict[tuple[str, str], dict[str, int]]]:
        """Counts of following words by the last word and by the last two."""
        if not hasattr(self, "_after"):
            one: dict[str, dict[str, int]] = {}
            two: dict[tuple[str, str], dict[str, int]] = {}
            for (a, b), c in self.bi.items():
                one.setdefault(a, {})[b] = c
            for (a, b, w), c in self.tri.items():
                two.setdefault((a, b), {})[w] = c
            self._after = (one, two)
        return self._after

    def unknown(self, word: str) -> float:
        """Probability of a word that is not in the vocabulary."""
        p = self.memo.get(word)
        if p is None:
            marked, score, n = f"^{word}$", 0.0, self.chars + 1
            for i in range(len(marked) - 2):
                gram = marked[i : i + 3]
                score += math.log2((self.ch3.get(gram, 0) + M.CHAR_K) / (self.ch2.get(gram[:2], 0) + M.CHAR_K * n))
            bonus = 1.0 * any(word.startswith(x) and len(word) > len(x) + 2 for x in M.PREFIXES) + 1.5 * any(word.endswith(x) and len(word) > len(x) + 2 for x in M.SUFFIXES)
            p = 2.0 ** max(M.CHAR_FLOOR, score / (len(word) + 1) * M.CHAR_SCALE + bonus - M.CHAR_SHIFT)
            if len(self.memo) < 200_000:
                self.memo[word] = p
        return p

    def probability(self, w1: str, w2: str, w3: str) -> float:
        p = 0.0
        if n := self.ctx2.get((w1, w2)):
            p += M.L3 * self.tri.get((w1, w2, w3), 0) / n
        if n := self.ctx1.get(w2):
            p += M.L2 * self.bi.get((w2, w3), 0) / n
        if (c := self.uni.get(w3)) is not None:
            p += M.L1 * c / self.total + M.L0 * M.KNOWN
        else:
            p += M.L0 * self.unknown(w3)
        return max(p, M.FLOOR)

    def segment(self, text: str, longest: int = LONGEST, beam: int = BEAM) -> list[str]:
        """The likeliest words of a text; [] for none."""
        text = text.strip().lower()
        n = len(text)
        if not n:
            return []
        after_one, after_two = self.after()
        # a cell holds its states with the words that may follow them
        cells: list[list[tuple]] = [[] for _ in range(n + 1)]
        # the best state of each last word: what an unknown word follows is told by no more than that
        heads: list[list[tuple]] = [[] for _ in range(n + 1)]
        heads[0] = cells[0] = [(0.0, None, BOS, after_one.get(BOS), self.ctx1.get(BOS, 0), after_two.get((BOS, BOS)), self.ctx2.get((BOS, BOS), 0))]
        ends: dict[tuple[str, str], tuple[float, tuple | None]] = {(BOS, BOS): (0.0, None)}
        for j in range(1, n + 1):
            here: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for i in range(max(0, j - longest), j):
                word = text[i:j]
                c = self.uni.get(word)
                if c is None and len(word) > UNKNOWN_LONGEST:
                    continue
                base = M.L1 * c / self.total + M.L0 * M.KNOWN if c is not None else M.L0 * self.unknown(word)
                plain = math.log2(max(base, M.FLOOR)) - (0.0 if c is not None else UNKNOWN_COST * len(word))
                for score, path, b, ones, n1, twos, n2 in cells[i] if c is not None else heads[i]:
                    p = 0.0
                    if c is not None:
                        if twos and (x := twos.get(word)):
                            p = M.L3 * x / n2
                        if ones and (x := ones.get(word)):
                            p += M.L2 * x / n1
                    s = score + (math.log2(max(p + base, M.FLOOR)) if p else plain)
                    old = here.get((b, word))
                    if old is None or s > old[0]:
                        here[b, word] = (s, (path, word))
            pruned = len(here) > beam
            if pruned:
                here = dict(heapq.nlargest(beam, here.items(), key=lambda x: x[1][0]))
            ends = here
            cells[j] = [(s, path, w, after_one.get(w), self.ctx1.get(w, 0), after_two.get((b, w)), self.ctx2.get((b, w), 0)) for (b, w), (s, path) in here.items()]
            heads[j] = cells[j]
            if pruned:  # states are in order of their scores, so the first one of a word is its best
                first: dict[str, tuple] = {}
                for state in cells[j]:
                    first.setdefault(state[2], state)
                heads[j] = list(first.values())
        best = max(ends.items(), key=lambda x: x[1][0] + math.log2(self.probability(x[0][0], x[0][1], EOS)))
        out, path = [], best[1][1]
        while path:
            path, word = path
            out.append(word)
        return out[::-1]

    def score(self, words: list[str]) -> float:
        """log2 probability of words with the end mark and the cost of unknown ones."""
        a, b, total = BOS, BOS, 0.0
        for w in [*words, EOS]:
            total += math.log2(self.probability(a, b, w)) - (0.0 if w in self.uni or w == EOS else UNKNOWN_COST * len(w))
            a, b = b, w
        return total


@dataclass
class Tables:
    """The interpolated model where it lies; only its words and characters are gathered, as flat bytes and up to hmm.MODEL_ROWS rows."""

    counts: M.Interpolated
    sentences: int


def model(rows: DataFrame, words: F.Column) -> Tables:
    """The interpolated model of sentences."""
    m = M.interpolated(rows, words)
    return Tables(m, m.tri.filter(F.col("w3") == EOS).agg(F.sum("c")).first()[0] or 0)


def _seen_pairs(bi: DataFrame) -> bytes:
    """A bit by the CRC of each pair of words, of PAIR_BITS at most: a pair whose bit is 0 was not seen."""
    n = min(PAIR_BITS, max(BLOCK, 16 * bi.count() // BLOCK * BLOCK))
    at = F.pmod(F.crc32(F.concat("w1", F.lit(" "), "w2").cast("binary")), F.lit(n))
    placed = bi.select(F.floor(at / BLOCK).cast("int").alias("block"), F.pmod(at, F.lit(BLOCK)).cast("int").alias("bit")).distinct()

    def block(t: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK, np.uint8)
        bits[t["bit"].to_numpy()] = 1
        return pa.table({"block": t["block"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    whole = bytearray(n // 8)
    for k, bits in placed.groupBy("block").applyInArrow(block, "block int, bits binary").toLocalIterator():
        whole[k * BLOCK // 8 : (k + 1) * BLOCK // 8] = bits
    return bytes(whole)


def _follows(seen: bytes, a: str, b: str) -> int:
    at = crc32(f"{a} {b}".encode()) % (8 * len(seen))
    return seen[at >> 3] & (128 >> (at & 7))


def _asked(texts: list[str], words: W.WordSet, seen: bytes) -> tuple[set, set]:
    """Pairs and triples of known words that a search of the texts may look up, with some that were never seen."""
    pairs: set[tuple[str, str]] = set()
    triples: set[tuple[str, str, str]] = set()
    for raw in texts:
        text = raw.strip().lower()
        n = len(text)
        known = [[w for k in range(1, min(LONGEST, n - i) + 1) if (w := text[i : i + k]) in words] for i in range(n)] + [[EOS]]
        at: list[set] = [set() for _ in range(n + 1)]  # pairs that end at a place
        pairs.add((BOS, BOS))
        for w in {*known[0], raw}:
            triples.add((BOS, BOS, w))
            if _follows(seen, BOS, w):
                pairs.add((BOS, w))
                if w != EOS and text.startswith(w):
                    at[len(w)].add((BOS, w))
        for i in range(n):
            for a in known[i]:
                j = i + len(a)
                for b in known[j]:
                    if _follows(seen, a, b):
                        pairs.add((a, b))
                        if b != EOS:
                            at[j + len(b)].add((a, b))
        for j in range(n + 1):
            triples.update((a, b, c) for a, b in at[j] for c in known[j] if (b, c) in pairs)
    return pairs, triples


def by_chunk(rows: DataFrame, text: str, m: Tables, use: Callable[[Model, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """What use(model, rows) gives for chunks of rows, the model holding all that a search of their texts looks up. Pairs and triples come to a chunk by joins."""
    held = C.deal(rows, text, F.coalesce(F.length(text), F.lit(0)) + 1, CHUNK_CHARS, "to-segment")
    t = m.counts
    words = W.gather(t.uni)
    single = lambda frame: {r[0]: r[-1] for r in _rows(frame, "the character table")}
    shared = rows.sparkSession.sparkContext.broadcast((words, _seen_pairs(t.bi), single(t.ch2), single(t.ch3)))
    total, chars, starts = t.total, t.chars, 2 * m.sentences

    def ask(group: pa.Table) -> pa.Table:
        pairs, triples = _asked([x or "" for x in group[text].to_pylist()], *shared.value[:2])
        found = [(*p, None) for p in pairs] + list(triples)
        columns = [pa.array(c, pa.string()) for c in zip(*found, strict=True)]
        return pa.table([pa.array([group[C.CHUNK][0].as_py()] * len(found), pa.int32()), *columns], [C.ASKED_BY, "w1", "w2", "w3"])

    dealt = held.select(C.CHUNK, text).repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, C.CHUNK)
    asked = materialise(dealt.groupBy(C.CHUNK).applyInArrow(ask, f"{C.ASKED_BY} int, w1 string, w2 string, w3 string"), "asked")
    two = asked.filter("w3 is null").drop("w3").join(t.bi, ["w1", "w2"]).select(C.ASKED_BY, "w1", "w2", F.lit(None).cast("string").alias("w3"), "c")
    three = asked.filter("w3 is not null").join(t.tri, ["w1", "w2", "w3"]).select(C.ASKED_BY, "w1", "w2", "w3", "c")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, _, ch2, ch3 = shared.value
        bi, tri = {}, {}
        for a, b, c, k in zip(*(right[x].to_pylist() for x in ("w1", "w2", "w3", "c")), strict=True):
            if c is None:
                bi[a, b] = k
            else:
                tri[a, b, c] = k
        # a word is followed as often as it comes, a pair of words too; the start mark comes twice a sentence
        ones = {a: starts if a == BOS else words.get(a, 0) for a, _ in bi}
        return use(Model(words, bi, tri, ch2, ch3, total, chars, ones, dict(bi), whole=False), left)

    return C.apply(held, two.unionByName(three), run, schema)


def _mapped(frame: DataFrame, text: str, name: str, make: Callable[[], Callable[[str], list[str] | None]]) -> DataFrame:
    schema = frame.withColumn(name, F.array(F.lit(""))).schema
    schema[name].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = make()
        for batch in batches:
            words = [cut(x.as_py() or "") for x in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], schema.fieldNames())

    return frame.mapInArrow(run, schema)


def segment_greedy(frame: DataFrame, vocab: DataFrame, text: str = "text", name: str = "words") -> DataFrame:
    """frame with an array of words by longest match. Of the vocabulary, the words that may match go to each worker as a WordSet."""
    words = vocab.select("w").distinct().filter(F.length("w").between(2, LONGEST)).withColumn("c", F.lit(1))
    held = frame.sparkSession.sparkContext.broadcast(W.gather(words))
    return _mapped(frame, text, name, lambda: lambda x: greedy(x, held.value))


def segment_search(frame: DataFrame, m: Tables | Model, text: str = "text", name: str = "words") -> DataFrame:
    """frame with an array of words by beam search, which is linear in the characters; texts of any length."""
    if isinstance(m, Model):
        held = frame.sparkSession.sparkContext.broadcast(m)
        return _mapped(frame, text, name, lambda: lambda x: held.value.segment(x))
    use = lambda part, rows: rows.append_column(name, pa.array([part.segment(x or "") for x in rows[text].to_pylist()], pa.list_(pa.string())))
    return by_chunk(frame, text, m, use, frame.withColumn(name, F.array(F.lit(""))).schema)
