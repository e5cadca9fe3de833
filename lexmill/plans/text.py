"""Queries of token, tag and corpus projections."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import strings as S
from lexmill.functions import tags as G
from lexmill.sources import views as V
from lexmill.sources.tables import table

TAGS = ["NP$", "PP$$", "VB+PPO", "FW-IN", "DT", "AP", "QL", "*", "--", "''", "", "NNS", "VBZ", "BEDZ*", "JJT", "PPSS", "PPS", "WDT", "MD", "NN-TL", "np-hl", "xyz", "AT", "NRS", "HVG", "OD", "CS", ".", "DTX", "VBN-HL", "NOUN-Masc-Sg", "det", "PN+HVD"]
WORDS = ["the", "These", "walks", "Both", "a", "any"]
FEATS = [("Gender=Fem|Number=Sing", "NOUN"), ("Mood=Ind|Number=Plur|Person=3|VerbForm=Fin", "AUX"), ("VerbForm=Inf", "VERB"), ("_", "ADP"), ("", "X"), (None, "DET"), ("Gender=|Number=Plur", "ADJ"), ("Person=1|VerbForm=Fin", "NOUN"), ("Person=2", "PRON"), ("Odd|Number=Sing|Person=", "VERB"), ("VerbForm=Ger|Person=", "VERB")]


def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.array_join(w, " ").alias("words"))


def tokenize_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.tokens_with_punctuation(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.detokenize(S.tokens_with_punctuation(F.col("text"))).alias("line"))


def edge_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.explode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("token"))
    t = t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("token")
    return t.select("token", "n", S.edge_clean(c).alias("clean"), S.edge_prefix(c).alias("prefix"), S.edge_suffix(c).alias("suffix"), S.bare(c).alias("bare"), S.clean_token(c).alias("letters"), S.restore_case(c, S.edge_clean(c)).alias("cased"))


def _tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(TAGS)], "id int, raw_tag string")


def _tag_values() -> str:
    return "(VALUES " + ", ".join("(%d, '%s')" % (i, t.replace("'", "''")) for i, t in enumerate(TAGS)) + ") t(id, raw_tag)"


def map_tag_universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark).select("id", "raw_tag", G.universal(F.col("raw_tag")).alias("tag"))


def map_tag_ptb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark).select("id", "raw_tag", G.treebank(F.col("raw_tag")).alias("tag"))


def tag_to_morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return _tags(spark).crossJoin(F.broadcast(words)).select("id", "raw_tag", "word", G.morph(F.col("word"), F.col("raw_tag")).alias("morph"))


def feats_to_morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(FEATS)], "id int, feats string, upos string").select("id", G.feats_morph(F.col("feats"), F.col("upos")).alias("morph"))


def reconcile_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark).select("id", "raw_tag", G.reconcile(F.col("raw_tag")).alias("tag"))


_CUT = "split_part(split_part(raw_tag, '-', 1), '+', 1)"
_DOLLAR = f"split_part({_CUT}, '$', 1) || CASE WHEN contains(raw_tag, '$') THEN '$' ELSE '' END"
_UP = "upper(regexp_replace(raw_tag, '[^A-Za-z]', '', 'g'))"
_BEGIN = "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with({_UP}, '{s}')" for s in starts) + f" THEN '{name}'" for starts, name in G.BEGINNINGS) + " ELSE 'X' END"
_UNIVERSAL = f"coalesce({G.sql_map(G.UNIVERSAL)}[raw_tag], {G.sql_map(G.UNIVERSAL)}[{_DOLLAR}], {G.sql_map(G.UNIVERSAL)}[{_UP}], {_BEGIN})"
_LETTERS = f"upper(regexp_replace({_CUT}, '[^A-Za-z]', '', 'g'))"
_MORPH = " ".join(
    " ".join(f"WHEN u = '{name}' AND (" + " OR ".join(f"contains(upper(raw_tag), '{p}')" for p in parts) + f") THEN '{form}'" for parts, form in cases) + f" WHEN u = '{name}' THEN '{rest}'"
    for name, (cases, rest) in G.FORMS.items()
)


def _in(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def unspaced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unspaced text and character spans of every sentence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for ws in batch.column(1).to_pylist():
                ends = list(accumulate(map(len, ws), initial=0))
                texts.append("".join(ws))
                spans.append(",".join([f"{a}-{b}" for a, b in pairwise(ends)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.string())], ["sent_id", "text", "spans"])

    return V.tagged_sentences(spark, sf_dir).select("sent_id", "ws").mapInArrow(run, "sent_id long, text string, spans string")


def corpus_union_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test parts put together again, with a sample of 100 test sentences by md5 order."""
    t = V.tagged(spark, sf_dir).select("sent_id", "split").distinct()
    train, test = t.filter("split = 'train'"), t.filter("split = 'test'")
    sample = test.orderBy(F.md5(F.col("sent_id").cast("string").cast("binary")), "sent_id").limit(100).select("sent_id", F.lit("sample").alias("split"))
    return train.unionByName(test).unionByName(sample).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("sent_id").alias("first"), F.sum(F.col("sent_id") % 1000003).alias("mark"))


QUERIES = {f.__name__: f for f in (tokenize_words, tokenize_punct, detokenize, edge_clean, map_tag_universal, map_tag_ptb, tag_to_morph, feats_to_morph, reconcile_tag, unspaced_spans, corpus_union_split)}

_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
ORACLES = {
    "tokenize_words": r"SELECT doc_id, len(w) AS n_words, coalesce(array_to_string(w, ' '), '') AS words FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)",
    "tokenize_punct": f"SELECT doc_id, len(t) AS n_tokens, coalesce(array_to_string(t, ' '), '') AS tokens FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "detokenize": rf"SELECT conv_id, turn, coalesce(array_to_string(list_transform(t, lambda x, i: CASE WHEN i = 1 OR regexp_matches(x, '^[^\p{{L}}\p{{N}}_\s]$') THEN x ELSE ' ' || x END), ''), '') AS line FROM (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations)",
    "edge_clean": r"""WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS token FROM conversations),
g AS (SELECT token, count(*) AS n, lower(regexp_replace(token, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')) AS clean FROM t GROUP BY token)
SELECT token, n, clean, regexp_extract(token, '^([.,!?;:"''()]*)', 1) AS prefix, regexp_extract(token, '([.,!?;:"''()]*)$', 1) AS suffix,
 lower(regexp_replace(token, '[^\p{L}\p{N}_]', '', 'g')) AS bare, lower(regexp_replace(token, '^[^\p{L}]+|[^\p{L}]+$', '', 'g')) AS letters,
 CASE WHEN regexp_matches(token[1], '\p{Lu}') THEN upper(clean[1]) || lower(substr(clean, 2)) ELSE clean END AS cased FROM g""",
    "map_tag_universal": f"SELECT id, raw_tag, {_UNIVERSAL} AS tag FROM {_tag_values()}",
    "map_tag_ptb": f"SELECT id, raw_tag, coalesce({G.sql_map(G.TREEBANK)}[raw_tag], {G.sql_map(G.TREEBANK)}[{_CUT}], {G.sql_map(G.TREEBANK)}[{_LETTERS}], {_UNIVERSAL}) AS tag FROM {_tag_values()}",
    "tag_to_morph": f"""SELECT id, raw_tag, word, CASE WHEN u = 'DET' AND lower(word) IN ({_in(G.SINGULAR)}) THEN 'DET-Sing' WHEN u = 'DET' AND lower(word) IN ({_in(G.PLURAL)}) THEN 'DET-Plur' WHEN u = 'DET' THEN 'DET-General' {_MORPH} ELSE u END AS morph
FROM (SELECT id, raw_tag, {_UNIVERSAL} AS u FROM {_tag_values()}), (VALUES {", ".join(f"('{w}')" for w in WORDS)}) w(word)""",
    "feats_to_morph": """SELECT id, CASE WHEN feats IS NULL OR feats IN ('', '_') THEN upos ELSE concat_ws('-', upos, nullif(regexp_extract(feats, '(?:^|\\|)Gender=([^|]*)', 1), ''), nullif(regexp_extract(feats, '(?:^|\\|)Number=([^|]*)', 1), ''),
 coalesce(CASE WHEN upos IN ('VERB', 'AUX', 'PRON') THEN 'P' || nullif(regexp_extract(feats, '(?:^|\\|)Person=([^|]*)', 1), '') END, CASE WHEN upos IN ('VERB', 'AUX') THEN nullif(regexp_extract(feats, '(?:^|\\|)VerbForm=([^|]*)', 1), '') END)) END AS morph
FROM (VALUES """.replace("\\\\", "\\") + ", ".join(f"({i}, {'NULL' if f is None else repr(f)}, '{u}')" for i, (f, u) in enumerate(FEATS)) + ") f(id, feats, upos)",
    "reconcile_tag": f"SELECT id, raw_tag, CASE WHEN raw_tag = '' THEN 'NN' ELSE coalesce({G.sql_map(G.GRAMMAR)}[raw_tag], {G.sql_map(G.GRAMMAR)}[upper({_DOLLAR})], upper({_DOLLAR})) END AS tag FROM {_tag_values()}",
    "unspaced_spans": V.with_views(
        """WITH p AS (SELECT sent_id, idx, w, coalesce(sum(length(w)) OVER (PARTITION BY sent_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM tok)
SELECT sent_id, string_agg(w, '' ORDER BY idx) AS text, string_agg(s::VARCHAR || '-' || (s + length(w))::VARCHAR, ',' ORDER BY idx) AS spans FROM p GROUP BY sent_id""",
        "tok",
    ),
    "corpus_union_split": V.with_views(
        """WITH t AS (SELECT DISTINCT sent_id, split FROM tagged), s AS (SELECT sent_id, 'sample' AS split FROM t WHERE split = 'test' ORDER BY md5(sent_id::VARCHAR), sent_id LIMIT 100)
SELECT split, count(*) AS n, min(sent_id) AS first, sum(sent_id % 1000003)::BIGINT AS mark FROM (SELECT * FROM t UNION ALL SELECT * FROM s) GROUP BY split""",
        "tagged",
    ),
}
