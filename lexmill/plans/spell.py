"""Queries of spelling correction. The vocabulary holds words of letters seen LEAST times or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import strings as S
from lexmill.operators import ngrams as N
from lexmill.operators import spelling as P
from lexmill.plans.counts import ALPHA, runs_sql
from lexmill.session import materialise
from lexmill.sources import views as V
from lexmill.sources.tables import table

LEAST = 3


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(P.vocabulary(V.sents(spark, sf_dir), F.col("ws"), LEAST), "vocabulary")  # read several times


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(N.count_runs(V.sents(spark, sf_dir).select(N.alpha_only(F.col("ws")).alias("ws")), F.col("ws"), 2), "bigrams")


def _cases(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    return materialise(P.test_cases(V.sents(spark, sf_dir), F.col("ws"), vocab), "cases")


def deletes_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.deletes_index(vocabulary(spark, sf_dir)).select("form", F.array_join("words", " ").alias("words"))


def edit1_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    return P.near_pairs(v.select(F.col("w").alias("q")), v).select("q", "w", S.is_edit1(F.col("q"), F.col("w")).alias("one_edit"))


def candidates_symdelete(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    return P.candidates(v.select(F.col("w").alias("q")), v)


def candidates_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    return P.candidates_by_edits(v.select(F.col("w").alias("q")), v)


def spell_testset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, vocabulary(spark, sf_dir)).select("kind", "sent_id", "i", "original", "typo")


def nonword_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    asked = _cases(spark, sf_dir, v).filter("kind = 'nonword'").select(F.col("typo").alias("q"))
    return P.correct_nonwords(asked, v)


def _phrases(cases: DataFrame) -> DataFrame:
    around = lambda k: F.when(F.col("i") + k >= 0, F.get("tokens", F.col("i") + k))
    return cases.filter("kind = 'realword'").select("sent_id", "original", around(-1).alias("prev"), F.col("typo").alias("q"), around(1).alias("next"))


def realword_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    return P.correct_realwords(_phrases(_cases(spark, sf_dir, v)), v, _bigrams(spark, sf_dir))


def _typed(cases: DataFrame) -> DataFrame:
    tokens = F.transform("tokens", lambda t, j: F.when(j == F.col("i"), F.col("typo")).otherwise(t))
    return cases.select("kind", "sent_id", tokens.alias("tokens"))


def sentence_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    out = P.correct_sentences(_typed(_cases(spark, sf_dir, v)), ["kind", "sent_id"], v, _bigrams(spark, sf_dir))
    return out.select("kind", "sent_id", F.array_join("fixed", " ").alias("fixed"), "n_changed")


def spell_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir)
    cases = _cases(spark, sf_dir, v)
    non = cases.filter("kind = 'nonword'").select("kind", "original", F.col("typo").alias("q"))
    non = non.join(P.correct_nonwords(non, v), "q").select("kind", "original", "fixed")
    phrases = _phrases(cases)
    real = P.correct_realwords(phrases, v, _bigrams(spark, sf_dir)).withColumnsRenamed({"prev": "p", "q": "q2", "next": "x"})
    same = F.col("q") == F.col("q2")
    real = phrases.join(real, same & F.col("prev").eqNullSafe(F.col("p")) & F.col("next").eqNullSafe(F.col("x"))).select(F.lit("realword").alias("kind"), "original", "fixed")
    both = non.unionByName(real)
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("fixed") == F.col("original")).cast("int")), 6).alias("accuracy"))


def spell_speed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.speed_batch(vocabulary(spark, sf_dir))


def _outside(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(S.words(F.col("text"))).alias("w"))
    return words.join(vocabulary(spark, sf_dir), "w", how).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first"))


def oov_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outside(spark, sf_dir, "left_anti")


def known_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outside(spark, sf_dir, "left_semi")


QUERIES = {f.__name__: f for f in (deletes_index, edit1_verify, candidates_symdelete, candidates_bruteforce, spell_testset, nonword_correct, realword_correct, sentence_correct, spell_accuracy, spell_speed_batch, oov_tokens, known_tokens)}


def hash_sql(key: str, of: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {of})"


def _edit_sql(word: str, seed: str) -> str:
    """The same edit as functions.strings.random_edit."""
    key = f"({word} || ':' || {seed})"
    n = f"length({word})"
    at, gap, left = (hash_sql(f"{key} || ':at'", x) for x in (f"greatest({n}, 1)", f"({n} + 1)", f"greatest({n} - 1, 1)"))
    op = f"CASE WHEN {n} >= 2 THEN {hash_sql(f'{key} || {chr(39)}:op{chr(39)}', '4')} ELSE {hash_sql(f'{key} || {chr(39)}:op{chr(39)}', '2')} + 1 END"
    letter = f"substr('{S.LETTERS}', {hash_sql(f'{key} || {chr(39)}:c{chr(39)}', '26')} + 1, 1)"
    cut, rest = (lambda a: f"substr({word}, 1, {a})"), (lambda a: f"substr({word}, {a} + 1)")
    swap = f"{cut(left)} || substr({word}, {left} + 2, 1) || substr({word}, {left} + 1, 1) || {rest(f'{left} + 2')}"
    return f"CASE {op} WHEN 0 THEN {cut(at)} || {rest(f'{at} + 1')} WHEN 1 THEN {cut(gap)} || {letter} || {rest(gap)} WHEN 2 THEN {cut(at)} || {letter} || {rest(f'{at} + 1')} ELSE {swap} END"


VOC = f"{ALPHA}, voc AS (SELECT w, count(*) AS c FROM (SELECT unnest(ws) AS w FROM alpha) GROUP BY w HAVING count(*) >= {LEAST})"
_DEL = "list_distinct(list_transform(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1)))"


# DuckDB's edit distances count bytes; this counts characters of pairs that share a deletion form
ONE_EDIT = f"""CASE length(w) - length(q) WHEN 1 THEN list_contains({_DEL}, q) WHEN -1 THEN list_contains({_DEL.replace("(w", "(q")}, w)
 ELSE len(list_filter(range(1, length(w) + 1), lambda i: w[i] <> q[i])) = 1 OR len(list_filter(range(1, length(w)), lambda i: substr(w, 1, i - 1) || w[i + 1] || w[i] || substr(w, i + 2) = q)) > 0 END"""


def _keys_sql(name: str, source: str, word: str) -> str:
    return f"{name} AS (SELECT {word}, unnest(list_distinct([{word}] || {_DEL.replace('(w', f'({word}')})) AS form FROM {source})"


def cand_sql(queries: str) -> str:
    """CTEs near (unchecked pairs) and cand (checked) for a relation of column q."""
    return f"{_keys_sql('kq', f'(SELECT DISTINCT q FROM {queries})', 'q')}, {_keys_sql('kw', 'voc', 'w')}, near AS (SELECT DISTINCT q, w FROM kq JOIN kw USING (form) WHERE q <> w), cand AS (SELECT q, w FROM near WHERE {ONE_EDIT})"


_BI = f"{runs_sql('ar', 'alpha', 'ws', 2)}, bi AS (SELECT w1, w2, count(*) AS c FROM ar GROUP BY ALL), ctx AS (SELECT w1, count(*) AS n FROM ar GROUP BY ALL)"
CASES = f"""smp AS (SELECT sent_id, tokens, {hash_sql("sent_id::VARCHAR || ':i'", "len(tokens)")} AS i FROM (SELECT sent_id, ws AS tokens FROM alpha) WHERE len(tokens) >= 2 AND {hash_sql("sent_id::VARCHAR || ':s'", "10")} = 0),
smo AS (SELECT *, tokens[i + 1] AS original FROM smp),
tri AS (SELECT *, {_edit_sql("original", "(sent_id::VARCHAR || ':' || kind || ':' || k)")} AS typo FROM (SELECT sent_id, original, kind, unnest(range(20)) AS k FROM smo, (VALUES ('nonword'), ('realword')) kk(kind))),
cases AS (SELECT f.kind, sent_id, tokens, i, original, typo FROM (SELECT kind, sent_id, arg_min(typo, k) AS typo FROM tri WHERE typo <> original AND (kind = 'nonword') = (typo NOT IN (SELECT w FROM voc)) GROUP BY ALL) f JOIN smo USING (sent_id))"""
_NON = "nonfix AS (SELECT q, coalesce(b.w, q) AS fixed FROM (SELECT DISTINCT q FROM asked) LEFT JOIN (SELECT q, min({'n': -c, 'w': cand.w}) AS b FROM cand JOIN voc USING (w) GROUP BY q) USING (q))"


def real_sql(phrases: str, margin: float) -> str:
    """CTE realfix (prev, q, next, fixed) for a relation of phrases."""
    return f"""vs AS (SELECT count(*) AS v FROM voc), ph AS (SELECT DISTINCT prev, q, next FROM {phrases}),
trd AS (SELECT prev, ph.q, next, w FROM ph JOIN cand ON ph.q = cand.q UNION ALL SELECT prev, q, next, q FROM ph),
scr AS (SELECT prev, q, next, w, round(CASE WHEN prev IS NULL THEN 0 ELSE ln((coalesce(b1.c, 0) + 1)::DOUBLE / (coalesce(c1.n, 0) + v)) END + CASE WHEN next IS NULL THEN 0 ELSE ln((coalesce(b2.c, 0) + 1)::DOUBLE / (coalesce(c2.n, 0) + v)) END, 9) AS s
 FROM trd LEFT JOIN bi b1 ON b1.w1 = prev AND b1.w2 = w LEFT JOIN ctx c1 ON c1.w1 = prev LEFT JOIN bi b2 ON b2.w1 = w AND b2.w2 = next LEFT JOIN ctx c2 ON c2.w1 = w, vs),
realfix AS (SELECT prev, q, next, CASE WHEN b.w <> '' AND round(-b.n - own, 9) > {margin} THEN b.w ELSE q END AS fixed FROM (SELECT prev, q, next, max(CASE WHEN w = q THEN s END) AS own, min({{'n': -s, 'w': CASE WHEN w = q THEN '' ELSE w END}}) AS b FROM scr GROUP BY prev, q, next))"""


_PHRASES = "phr AS (SELECT sent_id, original, CASE WHEN i > 0 THEN tokens[i] END AS prev, typo AS q, tokens[i + 2] AS next FROM cases WHERE kind = 'realword')"
_ASK_NON = "asked AS (SELECT typo AS q, original FROM cases WHERE kind = 'nonword')"
_VOCQ = "vq AS (SELECT w AS q FROM voc)"

ORACLES = {
    "deletes_index": V.with_views(f"WITH {VOC} SELECT form, array_to_string(list_sort(list(DISTINCT w)), ' ') AS words FROM (SELECT w, unnest({_DEL}) AS form FROM voc) GROUP BY form", "sents"),
    "edit1_verify": V.with_views(f"WITH {VOC}, {_VOCQ}, {cand_sql('vq')} SELECT q, w, {ONE_EDIT} AS one_edit FROM near", "sents"),
    "candidates_symdelete": V.with_views(f"WITH {VOC}, {_VOCQ}, {cand_sql('vq')} SELECT q, w FROM cand", "sents"),
    # of two words one edit apart, the one that the edit reaches must put only a to z where they differ
    "candidates_bruteforce": V.with_views(
        rf"""WITH {VOC}, {_VOCQ}, {cand_sql("vq")} SELECT q, w FROM cand WHERE length(w) < length(q) OR (length(w) = length(q) AND (list_sort(string_split(q, '')) = list_sort(string_split(w, ''))
 OR len(list_filter(range(1, length(w) + 1), lambda i: w[i] <> q[i] AND regexp_matches(w[i], '[a-z]'))) = 1)) OR (length(w) > length(q) AND len(list_filter(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1) = q AND regexp_matches(w[i], '[a-z]'))) > 0)""",
        "sents",
    ),
    "spell_testset": V.with_views(f"WITH {VOC}, {CASES} SELECT kind, sent_id, i, original, typo FROM cases", "sents"),
    "nonword_correct": V.with_views(f"WITH {VOC}, {CASES}, {_ASK_NON}, {cand_sql('asked')}, {_NON} SELECT q, fixed FROM nonfix", "sents"),
    "realword_correct": V.with_views(f"WITH {VOC}, {_BI}, {CASES}, {_PHRASES}, {cand_sql('phr')}, {real_sql('phr', P.MARGIN)} SELECT prev, q, next, fixed FROM realfix", "sents"),
    "sentence_correct": V.with_views(
        f"""WITH {VOC}, {_BI}, {CASES}, typed AS (SELECT kind, sent_id, list_transform(tokens, lambda t, j: CASE WHEN j = i + 1 THEN typo ELSE t END) AS tokens FROM cases),
tk AS (SELECT kind, sent_id, j, tokens[j] AS token, CASE WHEN regexp_matches(tokens[j], '^\\p{{L}}+$') THEN tokens[j] END AS q, CASE WHEN j > 1 AND regexp_matches(tokens[j - 1], '^\\p{{L}}+$') THEN tokens[j - 1] END AS prev, CASE WHEN regexp_matches(tokens[j + 1], '^\\p{{L}}+$') THEN tokens[j + 1] END AS next FROM (SELECT kind, sent_id, tokens, unnest(range(1, len(tokens) + 1)) AS j FROM typed)),
kn AS (SELECT * FROM tk WHERE q IN (SELECT w FROM voc)), asked AS (SELECT q FROM tk WHERE q NOT IN (SELECT w FROM voc)), allq AS (SELECT q FROM tk WHERE q IS NOT NULL),
{cand_sql("allq")}, {_NON}, {real_sql("kn", P.MARGIN)},
fx AS (SELECT tk.kind, tk.sent_id, tk.j, tk.token, coalesce(r.fixed, n.fixed, tk.token) AS w FROM tk LEFT JOIN nonfix n ON tk.q = n.q LEFT JOIN realfix r ON tk.q = r.q AND tk.prev IS NOT DISTINCT FROM r.prev AND tk.next IS NOT DISTINCT FROM r.next)
SELECT kind, sent_id, string_agg(w, ' ' ORDER BY j) AS fixed, sum((w <> token)::INT)::BIGINT AS n_changed FROM fx GROUP BY kind, sent_id""".replace("\\\\", "\\"),
        "sents",
    ),
    "spell_accuracy": V.with_views(
        f"""WITH {VOC}, {_BI}, {CASES}, {_ASK_NON}, {_PHRASES}, allq AS (SELECT q FROM asked UNION SELECT q FROM phr), {cand_sql("allq")}, {_NON}, {real_sql("phr", P.MARGIN)}
SELECT kind, count(*) AS n, round(avg((fixed = original)::INT), 6) AS accuracy FROM (SELECT 'nonword' AS kind, original, fixed FROM asked JOIN nonfix USING (q)
 UNION ALL SELECT 'realword', original, fixed FROM phr JOIN realfix r ON phr.q = r.q AND phr.prev IS NOT DISTINCT FROM r.prev AND phr.next IS NOT DISTINCT FROM r.next) GROUP BY kind""",
        "sents",
    ),
    "spell_speed_batch": V.with_views(f"WITH {VOC} SELECT w AS original, {_edit_sql('w', chr(39) + 'batch' + chr(39))} AS typo FROM (SELECT w FROM voc ORDER BY md5(w) LIMIT 1000)", "sents"),
    "oov_tokens": V.with_views(rf"WITH {VOC} SELECT w, count(*) AS n, min(item_id) AS first FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM benchmark) WHERE w NOT IN (SELECT w FROM voc) GROUP BY w", "sents"),
    "known_tokens": V.with_views(rf"WITH {VOC} SELECT w, count(*) AS n, min(item_id) AS first FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM benchmark) WHERE w IN (SELECT w FROM voc) GROUP BY w", "sents"),
}
