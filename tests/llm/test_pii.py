"""Base spans against plain patterns, and disclosed terms against counts by hand."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from lexmill.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
}
TERM = re.compile(r"""(?<![^ \t\n\x0b\f\r"'(])(?=[0-9'\u2019-]*[^\W\d_])[^\W_](?:['\u2019-]?[^\W_])+(?=[.,;:!?"')]*(?:[ \t\n\x0b\f\r]|$))""")


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in p.finditer(text or "") if passes(k, m.group())]


def named(kind, v):
    return kind + ":" + (v.lower() if k_is_text(kind) else re.sub("[^0-9]", "", v))


def k_is_text(kind):
    return kind in ("email", "ip")


def classes(term):
    return f"{term[0]}*{len(term)}", f"*{len(term)}"


def disclosed(texts):
    """{text: {term: what replaces it}} by counting."""
    copies = Counter(t for t in texts if t is not None)
    total = sum(copies.values())
    near, of_term, words = defaultdict(set), Counter(), {}
    for t, n in copies.items():
        words[t] = set(TERM.findall(t.lower()))
        of_term.update(dict.fromkeys(words[t] | {c for x in words[t] for c in classes(x)}, n))
        for k, s, e, v in base(t):
            a, b = max(0, s - pii.WINDOW), e + pii.WINDOW
            left, right = t[a:s], t[e:b]
            left = re.sub(r"^\S+", "", left) if a else left
            right = re.sub(r"\S+$", "", right) if b < len(t) else right
            near[named(k, v), t] |= set(TERM.findall((left + " " + right).lower()))
    mentions, together = Counter(), Counter()
    for (entity, t), terms in near.items():
        mentions[entity] += copies[t]
        together.update({(entity, x): copies[t] for x in terms | {c for x in terms for c in classes(x)}})

    def share(entity, x):
        p = mentions[entity] / total
        return round(1 + math.log2((together[entity, x] + p) / (of_term[x] + 1)) / -math.log2(p), 9) if p < 1 else 0.0

    told = defaultdict(dict)
    for entity, x in together:
        if "*" not in x and (s := share(entity, x)) >= pii.GENERALISE:
            class_ = next((c for c in classes(x) if share(entity, c) < pii.GENERALISE), None)
            told[entity][x] = (s >= pii.REMOVE, "" if s >= pii.REMOVE else f"[{class_}]" if class_ else "[TERM]")
    out = defaultdict(dict)
    for entity, t in near:
        for x, (gone, instead) in told[entity].items():
            if x in words[t]:
                out[t][x] = max(out[t].get(x, (False, -99, "")), (gone, -len(instead), instead))
    return {t: {x: w[2] for x, w in held.items()} for t, held in out.items()}


def expected(rows):
    told = disclosed([t for _, t in rows])
    out = []
    for i, t in rows:
        found = base(t)
        listed = [f"{k}:{s}:{e}" for k, s, e, _ in found]
        words = [f"term:{m.start()}:{m.end()}" for m in TERM.finditer(t or "") if m.group().lower() in told.get(t, {})] if t else []
        count = Counter(k for k, *_ in found)
        out.append((i, *(count[k] for k in pii.KINDS), hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join(listed + words), len(words)))
    return sorted(out, key=str)


def check(spark, rows):
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    return got


EDGES = [
    None, "", " ", "a@b.c@d.e x@y", "a@b.c_d@e.f..g@h.i.", "x..y@z-.co.uk!", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 001.002.003.0255 0000000000000001.1.1.1", "999999999999.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112222 4111111111111111-", "+1 (386) 555-3733 +1.2 +49 30 1234567890123 +(1) +1--2 +12345678)",
    "é日本🙂 mail é.x@y.fr 🙂+33 1 22 33 44 55🙂", "5" * 70000, "1 " * 30000, "a" * 50000 + "@", ("z" * 40 + ".") * 2000 + "@x", "9.9.9.9" * 300, "a@" + "b." * 900 + "c", "a@" + "b." * 1499 + "c", "a@" + "b." * 59999 + "c", "\x1f1.1.1.1\x1f",
]


def test_edges(spark):
    check(spark, [(i, t) for i, t in enumerate(EDGES)] + [(None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd")])


def test_tables(spark):
    import duckdb

    check(spark, duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())


def test_terms(spark):
    rows = [(i, f"Please call Wolfram Quarz at +49 30 1234567{i % 2} about item number{i} today") for i in range(12)]
    rows += [(100 + i, f"Please call somebody about {i} today") for i in range(60)] + [(200, "Wolfram is alone here")]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert got[0].n_term and not got[200].n_term and not got[101].n_term
    clean = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_chars long, spans string")).collect()}
    assert "[PHONE]" in clean[0].text and "1234567" not in clean[0].text and clean[0].n_chars == len(clean[0].text) and clean[0].spans == "x"
    assert clean[200].text == "Wolfram is alone here" and len(clean) == len(rows)


def test_one_mention_of_a_rare_name(spark):
    far = "please do call us " * 30
    rows = [(0, f"Ask Jo O'Neil-Quarz on +49 30 12345678 today. {far} O'Neil-Quarz said so."), (1, "Jo and we call today"), (2, "and we call")]
    rows += [(10 + i, f"Please do ask and call us on any day, Jack O'Neill or Al, item {i} today") for i in range(2000)]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert got[0].n_term == 3 and not any(got[i].n_term for i in got if i)
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the unique name goes wherever it stands; the rare first name becomes a class that is common
    assert "Quarz" not in clean[0] and "Ask [*2]  on [PHONE] today." in clean[0] and "please do call us" in clean[0]
    assert all(clean[i] == t for i, t in rows if i)


def test_many_matches_in_long_texts(spark):
    text = " ".join(f"x{i}@y.de 10.0.{i % 256}.1 word{i % 7}" for i in range(4000))
    got = check(spark, [(1, text), (2, text + " 9.9.9.9")])
    assert got[0].n_email == 4000 and got[0].n_ip == 4000


def test_empty_and_clashing_columns(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a@b.cd", "x", 2, None)], "doc_id long, text string, spans string, text_key int, __t string")
    assert pii.find(odd).first().n_email == 1
    assert pii.sanitise(odd).first().asDict() == {"doc_id": 1, "text": "[EMAIL]", "spans": "x", "text_key": 2, "__t": None}
