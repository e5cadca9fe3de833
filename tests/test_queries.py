"""Every query with an oracle gives the oracle's rows; the others give well-formed ones."""

import pytest

from lexmill.plans import catalogue
from lexmill.plans.parity import compare

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same, what = compare(catalogue.queries()[name](spark, SF), ORACLES[name], SF)
    assert same, what


def test_parses_are_trees(spark):
    for r in catalogue.queries()["dep_parse"](spark, SF).collect():
        assert r.n == r.headed == len(r.arcs.split())


def test_segmentation_keeps_the_text(spark):
    from pyspark.sql import functions as F

    from lexmill.plans import tagging

    text = {r.sent_id: r.text for r in tagging._unspaced(spark, SF).collect()}
    for r in tagging.segment_dp(spark, SF).collect():
        assert r.words.replace(" ", "") == text[r.sent_id]
    assert tagging.hmm_accuracy(spark, SF).select(F.col("accuracy")).first()[0] > 60


def test_search_segments_long_sentences(spark, monkeypatch):
    from lexmill.operators import segment
    from lexmill.plans import tagging

    gold = spark.createDataFrame([(1, ["ab"] * 13, "ab" * 13), (2, ["ab"] * 1500, "ab" * 1500), (3, ["ab"], "ab")], "sent_id long, words array<string>, text string")
    monkeypatch.setattr(tagging, "_unspaced", lambda *_: gold)
    monkeypatch.setattr(segment, "model", lambda *_: segment.Model({"ab": 1}, {}, {}, {}, {}, 1, 2))
    assert {r.sent_id: len(r.words.split()) for r in tagging.segment_dp(spark, SF).collect()} == {1: 13, 2: 1500, 3: 1}
    metrics = tagging.seg_dp_metrics(spark, SF).first()
    assert metrics.n_gold == metrics.matched == 1514


def test_editor_rows(spark):
    q = catalogue.queries()
    tokens = q["editor_tokens"](spark, SF)
    assert tokens.count() == q["typing_merge"](spark, SF).count()
    assert {r[0] for r in tokens.select("alert").distinct().collect()} <= {None, "SEGMENT-ALERT", "SPELL-ALERT"}
    assert all(len(r.out.split()) == len(r.tags.split()) for r in tokens.filter("alert = 'SEGMENT-ALERT'").collect())
    verdicts = q["passage_verdicts"](spark, SF)
    assert {r[0] for r in verdicts.select("verdict").distinct().collect()} <= {"Grammatical", "Questionable", "Acceptable", "Ungrammatical"}
    assert q["grammar_windows"](spark, SF).filter("acc % 5 <> 0").count() == 0
