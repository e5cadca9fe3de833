"""Token counts that follow edits: segment trees over pre-split words.

The words of a text are the leaves of a segment tree, LEAF words to a leaf. A node
holds the characters and tokens below it. An edit finds its leaf by descent over
character sums, re-splits from a few characters before the change until a word ends
where an old word ended, re-encodes only those words, and updates the sums on the way
up. Where the split stands at a text position decides all that follows, so the rest of
the tree stays as it is. A special token in the text is a word of its own, as it is for the
encoder; an edit that makes, breaks or joins one is met by re-splitting from as far before.

A text, its tree and its edits live in one row of an Arrow batch; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import bpe
from lexmill.llm.tokenizer import TOKENIZER, tokenizer_path
from lexmill.session import small_batches
from lexmill.sources.tables import table

LEAF = 64
#: A word is decided by at most so many characters from its start, and so many after its end; both grow by the longest special token.
AHEAD, AFTER = 3, 2
EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("new", T.StringType())])


class CountTree:
    """Token counts of one text under edits. words: the text's pre-split words, where they are known."""

    def __init__(self, text: str, coder: bpe.Automaton, words: list[str] | None = None) -> None:
        self.text, self.coder = text, coder
        self.encoded_words = self.encoded_chars = 0
        longest = max(map(len, coder.specials), default=0)
        self.ahead, self.after = AHEAD + longest, AFTER + longest
        if words is None:
            words = self._split(text)
        self.words = len(words)
        self._build([self._measure(words[i : i + LEAF]) for i in range(0, len(words), LEAF)])
        self.encoded_words = self.encoded_chars = 0

    def _split(self, text: str) -> list[str]:
        return [w for part in self.coder.cut_specials(text) for w in ([part] if part in self.coder.specials else self.coder.split(part))]

    def _measure(self, words: list[str]) -> list[tuple[int, int]]:
        self.encoded_words += len(words)
        lengths = list(map(len, words))
        self.encoded_chars += sum(lengths)
        specials, known = self.coder.specials, self.coder.word
        return [(n, 1 if w in specials else len(known(w)) // 4) for n, w in zip(lengths, words, strict=True)]

    def _build(self, leaves: list[list[tuple[int, int]]]) -> None:
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.leaves = leaves + [[] for _ in range(self.size - len(leaves))]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i] = sum(c for c, _ in leaf)
            self.tokens[self.size + i] = sum(t for _, t in leaf)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        """Tokens of the whole text."""
        return self.tokens[1]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at that place (the last for the end), and where it starts."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def edit(self, start: int, length: int, new: str) -> None:
        """Replaces ``length`` characters from ``start`` by ``new``; both are cut to the text."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(start + length, len(self.text)))
        old_size = len(self.text)
        self.text = self.text[:start] + new + self.text[end:]
        if not old_size:
            self._build([self._measure(self._split(self.text))])
            return
        first, leaf_start = self._leaf_at(max(0, start - self.ahead - self.after))
        skip, at = 0, leaf_start
        for size, _ in self.leaves[first]:
            if at + max(size + self.after, self.ahead) > start:
                break
            at += size
            skip += 1
        at0, shift = at, len(new) - (end - start)
        # old word ends beyond the change, in new places, from the leaf of the change on
        last, old_at = first, leaf_start
        ends: dict[int, tuple[int, int]] = {}
        found: list[str] = []
        new_at, read = at0, first
        reach, done = len(new) + 64 + 2 * self.after, None
        while done is None:
            piece = self.text[new_at : new_at + reach]
            whole = new_at + reach >= len(self.text)
            words = self._split(piece)
            if not whole:  # the cut may have changed the last ones
                sure, kept = len(piece) - self.after, 0
                for kept, word in enumerate(words):
                    sure -= len(word)
                    if sure < 0:
                        break
                words = words[:kept]
                if not words:
                    reach *= 2
                    continue
            for word in words:
                new_at += len(word)
                found.append(word)
                while read < self.size and old_at + shift <= new_at:
                    for k, (size, _) in enumerate(self.leaves[read]):
                        old_at += size
                        if old_at >= end:
                            ends[old_at + shift] = (read, k + 1)
                    read += 1
                if new_at >= start + len(new) and new_at in ends:
                    done = ends[new_at]
                    break
            else:
                if whole:
                    done = (self.size - 1, len(self.leaves[-1]))
        last, upto = done
        measured = self._measure(found)
        if first == last:
            self.leaves[first][skip:upto] = measured
        else:
            self.leaves[first][skip:] = measured
            for i in range(first + 1, last):
                self.leaves[i] = []
            self.leaves[last][:upto] = []
        if len(self.leaves[first]) > 8 * LEAF:
            flat = [w for leaf in self.leaves for w in leaf]
            self._build([flat[i : i + LEAF] for i in range(0, len(flat), LEAF)])
            return
        lo, hi = first + self.size, last + self.size
        for i in range(lo, hi + 1):
            self.chars[i] = sum(c for c, _ in self.leaves[i - self.size])
            self.tokens[i] = sum(t for _, t in self.leaves[i - self.size])
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            for i in range(lo, hi + 1):
                self._sum(i)


def trees(texts: list[str], coder: bpe.Automaton) -> Iterator[CountTree]:
    """The tree of every text; new words are encoded many at once."""
    for text, pieces in zip(texts, coder.pieces(texts), strict=True):
        yield CountTree(text, coder, [w for x in pieces for w in ([x] if isinstance(x, str) else x)])


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(x, T.LongType()) for x in ("n_before", "n_after", "n_words", "n_edits", "words_encoded", "chars_encoded")] + [T.StructField("after", T.ArrayType(T.LongType()))])


def count_edited(docs: DataFrame, edits_col: str = "edits", tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, token counts before and after its edits and after each one, words, edits, and what edits re-encoded.

    edits_col is an array of (start, length, new): each replaces length characters from
    start, in order, by new. Places beyond the text are cut to it; null numbers count
    as 0, a null new as empty, a null edit is skipped. A null text is an empty one, null
    edits are none. Special tokens in a text count as one token each. Other columns are not
    read and may have any name. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.automaton(tokenizer_path(tokenizer))
        for batch in batches:
            rows = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for tree, edits in zip(trees(texts, coder), batch.column(2), strict=True):
                before, words, after = tree.total, tree.words, []
                for e in edits.as_py() or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, max(0, e["length"] or 0), e["new"] or "")
                        after.append(tree.total)
                rows.append((before, tree.total, words, len(after), tree.encoded_words, tree.encoded_chars, after))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64()] * 6 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], SCHEMA.fieldNames())

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).cast(T.ArrayType(EDIT)).alias("edits"))
    return narrow.mapInArrow(run, SCHEMA)


#: Texts that made-up edits insert.
INSERTED = (" inserted", "", "x", "'ll", "\n\n", " 2024", "é", " and then some more words")


def made_edits(doc_id: str = "doc_id", text: str = "text", edits: int = 4) -> str:
    """SQL of an array of edits that depend on the id only: places over the whole text, up to 15 characters replaced."""
    new = "element_at(array({}), cast(pmod(xxhash64({}, {}, 3), {}) + 1 as int))"
    quoted = ", ".join("'" + x.replace("'", "\\'").replace("\n", "\\n") + "'" for x in INSERTED)
    one = "named_struct('start', pmod(xxhash64({0}, {1}, 1), length(coalesce({2}, '')) + 1), 'length', pmod(xxhash64({0}, {1}, 2), 16), 'new', {3})"
    return "array(" + ", ".join(one.format(doc_id, k, text, new.format(quoted, doc_id, k, len(INSERTED))) for k in range(edits)) + ")"


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", F.expr(made_edits()))
    return count_edited(docs).drop("after")


QUERIES = {"op3_edit_counts": op3_edit_counts}
#: Encoding is not SQL; the query is tested against encoding every edited text anew.
ORACLES: dict[str, str] = {}
