"""Kernels and column functions against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lexmill.functions import strings as S
from lexmill.operators import deps as D
from lexmill.operators import hmm as H
from lexmill.operators import pcfg as P
from lexmill.operators import segment as G
from lexmill.operators import spelling as C


def test_oracle_and_configuration():
    tags = ["DET", "NOUN", "VERB"]
    steps = D.oracle([2, 3, 0], ["det", "nsubj", "root"], tags)
    assert [m for _, m, _ in steps] == [D.SHIFT, D.SHIFT, D.LEFT, D.SHIFT, D.LEFT, D.RIGHT]
    assert steps[0][0] == (D.ROOT_TAG, D.NO_TAG, "DET", "NOUN")
    assert D.oracle([3, 4, 0, 3], ["a"] * 4, ["X"] * 4) is None
    assert D.oracle([-1, 0], ["a", "b"], ["X", "X"]) is None
    with pytest.raises(ValueError):
        D.Configuration(1).apply(D.LEFT, "x")
    assert [a[1] for a in D.parse(["X"] * 4, {})] == [1, 2, 3, 4] and D.parse([], {}) == []


def test_trees_and_cky():
    t = P.read_tree("( (S (NP-SBJ (DT the) (JJ old) (NN man)) (VP (VBD walked)) (. .)) )")
    assert P.write_tree(P.binarise(t)) == "(S (NP (DT the) (@NP_1 (JJ old) (NN man))) (@S_1 (VP (VBD walked)) (. .)))"
    assert P.read_tree("(S (NP") is None and P.read_tree("") is None
    g = P.Grammar({"DT": {"NN": [("NP", math.log(0.5))]}}, {"NP": [("S", math.log(0.25))]}, {"the": [("DT", 0.0)], "dog": [("NN", math.log(0.1))]}, {"NN": 0.0})
    tree, lp, status = g.parse(["The", "dog"])
    assert tree == "(NP (DT The) (NN dog))" and status == "parsed" and lp == pytest.approx(math.log(0.05))
    assert g.parse(["the", "cat"], ["AT", "NN"])[1] == pytest.approx(math.log(0.5) - 1.5)
    assert g.parse([])[2] == "unparseable: empty input" and g.parse(["the", "the"])[2] == "unparseable" and g.parse(["a"] * 41)[2] == "too long"


def test_greedy_and_search():
    words = {"the": 5, "quick": 2, "brown": 2, "fox": 3, "foxes": 1, "jumps": 1}
    assert G.greedy("Thequickfoxes!", set(words)) == ["the", "quick", "foxes", "!"] and G.greedy("", set()) == []
    m = G.Model(words, {("<s>", "the"): 3, ("the", "fox"): 2, ("fox", "jumps"): 1, ("jumps", "</s>"): 1}, {("<s>", "<s>", "the"): 3}, {}, {}, 14, 20)
    assert m.segment("thefoxjumps") == ["the", "fox", "jumps"] and m.segment("") == []
    assert m.score(m.segment("thefoxjumps")) >= m.score(G.greedy("thefoxjumps", set(words)))
    assert "".join(m.segment("zzthezz")) == "zzthezz"


def test_tagger(spark):
    rows = [(s, i, w, t) for s in range(5) for i, (w, t) in enumerate([("the", "D"), ("dogs", "N"), ("run", "V")])] + [(9, 0, "run", "N")]
    tagged = spark.createDataFrame(rows, "sent_id long, idx int, w string, tag string")
    m = H.tagger(tagged)
    assert m.tag(["the", "cats", "run"])[0] == "D" and m.tag([]) == [] and len(m.tag(["x"] * 7)) == 7
    table = {(r.w, r.tag): r.p for r in H.emission_table(spark.createDataFrame([("the",), ("hogs",)], "w string"), tagged).collect()}
    assert table["the", "D"] == pytest.approx((5 + 1e-4) / (5 + 1e-4 * 4))
    assert table["hogs", "N"] == pytest.approx((5 + 0.1) / (5 + 0.1 * 3) * (6 + 1) / (16 + 3))
    for word, p in (("the", table["the", "D"]), ("hogs", table["hogs", "N"])):
        assert dict(m.emissions(word))["D" if word == "the" else "N"] == pytest.approx(math.log2(p))


def test_edits(spark):
    one = spark.createDataFrame([("ab", "ba"), ("ab", "ab"), ("ab", "abc"), ("café", "cafe"), ("at", "to"), ("a", ""), ("abcd", "badc"), ("é", "e")], "a string, b string")
    got = [r[0] for r in one.select(S.is_edit1(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, True, True, False, True, False, True]
    listed = spark.createDataFrame([("ab",), ("a",), ("",)], "w string").select("w", S.edits1(F.col("w")).alias("e"), S.deletes(F.col("w")).alias("d")).collect()
    assert {r.w: r.d for r in listed} == {"ab": ["b", "a"], "a": [""], "": []}
    assert {"ba", "b", "xab", "axb", "abx", "xb", "ab"} <= set(listed[0].e) and len(listed[2].e) == 26


def test_spelling_by_join_is_brute_force(spark):
    words = ["sentence", "have", "hello", "help", "held", "at", "to", "a", "cafe", "café", "see", "sea", "sew"]
    vocab = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "w string, c long")
    asked = spark.createDataFrame([("sentnce",), ("hav",), ("helo",), ("zzz",), ("at",), ("",)], "q string")
    fixed = {r.q: r.fixed for r in C.correct_nonwords(asked, vocab).collect()}
    assert fixed == {"sentnce": "sentence", "hav": "have", "helo": "held", "zzz": "zzz", "at": "a", "": "a"}
    near = {tuple(r) for r in C.candidates(asked, vocab).collect()}
    assert ("at", "to") not in near and {tuple(r) for r in C.candidates_by_edits(asked, vocab).collect()} <= near
    bi = spark.createDataFrame([("to", "see", 50), ("see", "the", 50)], "w1 string, w2 string, c long")
    phrase = spark.createDataFrame([("to", "sea", "the"), (None, "see", None)], "prev string, q string, next string")
    assert {(r.q, r.fixed) for r in C.correct_realwords(phrase, vocab, bi).collect()} == {("sea", "see"), ("see", "see")}


def test_models_by_chunk_are_whole_models(spark, monkeypatch):
    """The tagger gathers no word table: it works where more words than MODEL_ROWS are trained on, and tags as the whole model does."""
    rows = [(s, i, w, t) for s in range(6) for i, (w, t) in enumerate([("the", "D"), ("dogs", "N"), ("run", "V"), (f"x{s}", "N")])] + [(9, 0, "run", "N")]
    tagged = spark.createDataFrame(rows, "sent_id long, idx int, w string, tag string")
    whole = H.tagger(tagged)
    texts = [["the", "hogs", "run"], [], None, ["x1", "zz9", "the"], ["run"] * 40]
    monkeypatch.setattr(H, "MODEL_ROWS", 2)
    out = H.tag_sentences(spark.createDataFrame(list(enumerate(texts)), "sent_id long, ws array<string>"), "ws", tagged)
    assert {r.sent_id: r.pred for r in out.collect()} == {i: whole.tag(t or []) for i, t in enumerate(texts)}


def test_walk_and_parse_follow_the_configuration():
    """The kernels on plain numbers take the steps of oracle() and of Configuration, for trees, crossing arcs and heads out of range."""
    import random

    draw = random.Random(5)
    tags = ["A", "B", "C"]
    codes = [D.SHIFT, f"{D.LEFT}:x", f"{D.RIGHT}:y", f"{D.RIGHT}:root"]
    every = [*tags, D.NO_TAG, D.ROOT_TAG]
    ranks = {(a, b, c, d): draw.sample(codes, draw.randint(0, 4)) for a in every for b in every for c in every for d in every}
    for _ in range(3000):
        n = draw.randint(0, 7)
        heads = [draw.choice([i - 1, i + 1, draw.randint(-1, n + 1)]) if draw.random() < 0.8 else 0 for i in range(1, n + 1)]
        tag = [draw.choice(tags) for _ in heads]
        steps, walk = D.oracle(heads, [str(i) for i in range(1, n + 1)], tag), D._walk(heads)
        at = [D.ROOT_TAG, *tag, D.NO_TAG, D.NO_TAG]
        got = None if walk is None else [((at[a], at[b], at[c], at[c + 1]), D.SHIFT if not d else D.RIGHT if d > 0 else D.LEFT, str(abs(d)) if d else None) for d, a, b, c in walk]
        assert got == steps
        c = D.Configuration(n)
        while not c.done:
            legal = c.legal()
            move, label = (D.SHIFT, None) if D.SHIFT in legal else (D.RIGHT, "dep")
            for code in ranks[c.features(tag)]:
                if code.partition(":")[0] in legal:
                    move, label = code.partition(":")[0], code.partition(":")[2] or None
                    break
            c.apply(move, label)
        assert D.parse(tag, ranks) == sorted(c.arcs, key=lambda a: a[1])


def test_word_set_is_exact_and_unbounded(spark, monkeypatch):
    """A vocabulary of more than MODEL_ROWS words is held whole, and holds nothing else."""
    import pickle

    from lexmill.operators import wordset as W

    words = [f"w{i}" for i in range(400)] + ["é", "日本語", "foxes", "fox", "the", "quick"]
    held = pickle.loads(pickle.dumps(W.gather(spark.createDataFrame([(w, len(w)) for w in words], "w string, c long"))))
    assert all(held.get(w) == len(w) for w in words)
    assert not any(x in held for x in ("", "w", "4", "w400", "ox", "fo", "2", "e"))
    assert W.gather(spark.createDataFrame([], "w string, c long")).get("a") is None
    monkeypatch.setattr(H, "MODEL_ROWS", 10)
    vocab = spark.createDataFrame([(w,) for w in words], "w string")
    out = G.segment_greedy(spark.createDataFrame([("Thequickfoxes!",), (None,)], "text string"), vocab)
    assert [r.words for r in out.collect()] == [["the", "quick", "foxes", "!"], []]


def test_search_by_chunk_is_the_whole_model(spark, monkeypatch):
    """Pairs and triples come by joins: a model of more than its rows' limit is searched as if it were gathered whole."""
    import random

    from lexmill.operators import lm as M

    draw = random.Random(3)
    some = ["a", "ab", "ba", "abc", "cab", "b", "the", "fox", "thefox", "x" * 27]
    rows = spark.createDataFrame([([draw.choice(some) for _ in range(draw.randint(3, 9))],) for _ in range(80)], "ws array<string>")
    m = M.interpolated(rows, F.col("ws"))
    pick = lambda frame: {tuple(r[:-1]) if len(r) > 2 else r[0]: r[-1] for r in frame.collect()}
    whole = G.Model(pick(m.uni), pick(m.bi), pick(m.tri), pick(m.ch2), pick(m.ch3), m.total, m.chars)
    texts = ["".join(draw.choice(some + ["zz", "q"]) for _ in range(draw.randint(1, 12))) for _ in range(40)] + ["", None, "x" * 27, " ABthefox "]
    monkeypatch.setattr(H, "MODEL_ROWS", 60)
    monkeypatch.setattr(G, "_rows", lambda frame, what: frame.collect() if what == "the character table" else H._rows(frame, what))
    out = G.segment_search(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), G.model(rows, F.col("ws")))
    assert {r.i: r.words for r in out.collect()} == {i: whole.segment(t or "") for i, t in enumerate(texts)}
    use = lambda part, t: t.append_column("p", [[part.probability("<s>", "<s>", x or "") for x in t["text"].to_pylist()]])
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = G.by_chunk(frame, "text", G.model(rows, F.col("ws")), use, frame.withColumn("p", F.lit(0.5)).schema)
    assert {r.i: r.p for r in got.collect()} == {i: whole.probability("<s>", "<s>", t or "") for i, t in enumerate(texts)}
