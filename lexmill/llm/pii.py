"""Personal data and the terms that disclose it, by information-theoretic sanitisation.

Base spans (email, ip, card, phone) are found by patterns and checks. Each found value
is a protected entity e. Over all documents, a term t seen near a mention of e discloses
the share

    (log2 p(e|t) - log2 p(e)) / -log2 p(e)

of e's information, with p(e) the share of documents that mention e, and p(e|t) the
share of documents with t that have it near e, estimated as if one more document had t
and mentioned e by chance. So a rare term seen near e once tells much, and a common one
little. From REMOVE on a term is removed, from GENERALISE on it is replaced by a class:
its first letter and length, or its length alone, whichever is the first to disclose less
than GENERALISE of e in the same way. Terms are treated in the whole of every text that
mentions e, near the mention or not.

Everything is DataFrame functions. Statistics are aggregates that combine before their
shuffles: a value that a third of all texts mention is one row for each task. A mention
gives at most WINDOW characters of terms on either side, so pairs grow with the mentions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import materialise
from lexmill.sources.tables import table

#: Kinds in the order of their spans.
KINDS = ("email", "ip", "card", "phone")
# The patterns find the same leftmost matches as the plain ones would, but start only
# where a run starts or the last match ended, and never recurse over long runs.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: A term: letters and digits, a letter among them, with inner hyphens and apostrophes, two characters or more, between white space, with quotes and brackets before and punctuation after.
TERM = r"""(?<![^\s"'(])(?=[\p{N}'\u2019-]*+\p{L})[\p{L}\p{N}](?:['\u2019-]?+[\p{L}\p{N}])++(?=[.,;:!?"')]*+(?:\s|$))"""
WINDOW = 120
GENERALISE, REMOVE = 0.75, 0.9
#: Matches of a text that are placed together, so that long texts with many matches take time in proportion.
BLOCK = 256
#: Characters of the pieces of a text that windows are cut from.
PIECE = 4096
#: Rows of narrow tables up to which they are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 300_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        x = back.substr(i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(back) - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").substr(1, 4).cast("int") <= 255)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it stands in it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """An array that is not empty, cut into arrays of BLOCK."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def _spans(text: str, pattern: Column, found: str, between: str) -> tuple[Column, Column, Column]:
    """Expressions for the matches, the text between them, and (s, e, v) of each match from those two columns."""
    m, p = F.col(found), F.col(between)
    sizes = F.zip_with(m, F.slice(p, 1, F.size(m)), lambda v, gap: F.struct(F.length(gap).alias("gap"), F.length(v).alias("n"), v.alias("v")))
    empty = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("s"), (start + x["n"]).alias("e"), x["v"].alias("v"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def by_block(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.expr("cast(array(0) as array<int>)"), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(x, F.lit(0), lambda n, y: n + y["gap"] + y["n"]))))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda x, at: F.aggregate(x, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))

    placed = _once(_once(sizes, _blocks), by_block)
    return F.regexp_extract_all(F.col(text), pattern, F.lit(0)), F.split(F.col(text), pattern, -1), F.when(F.size(m) > 0, placed).otherwise(empty)


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """docs with an array column ``__<kind>`` of (s, e, v) for each kind; s and e count code points."""
    for kind in KINDS:
        pattern = F.lit(PATTERNS[kind])
        find, split, placed = _spans(text, pattern, "__m", "__p")
        hinted = F.col(text).contains("@") if kind == "email" else F.col(text).rlike(HINTS[kind])
        docs = docs.withColumn("__m", F.when(hinted, find).otherwise(F.array().cast("array<string>")))
        docs = docs.withColumn("__p", F.when(F.size("__m") > 0, split))
        docs = docs.withColumn(f"__{kind}", _kept(kind, placed)).drop("__m", "__p")
    return docs


def _kept(kind: str, placed: Column) -> Column:
    return F.filter(placed, lambda x: _passes(kind, x["v"]))


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(value) if kind in ("email", "ip") else _digits(value))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _hinted() -> Column:
    hinted = F.lit(False)
    for kind in KINDS:
        hinted = hinted | (F.col("text").contains("@") if kind == "email" else F.col("text").rlike(HINTS[kind]))
    return hinted


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, entity, term, copies): terms near any mention of an entity in a text, and how many documents have that text; a null term if there is none."""
    based = with_base(docs.select(F.col(text_col).alias("text")).filter(_hinted()).withColumn("row", F.monotonically_increasing_id()), "text")
    # windows are cut from pieces of the text, so that a long text with many mentions is not read anew for each
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / PIECE).cast("int")), lambda i: F.col("text").substr(i * PIECE + 1, F.lit(PIECE)))
    based = based.withColumn("__pieces", pieces).withColumn("__size", F.length("text"))

    def near(x: Column) -> Column:
        start, end = F.greatest(x["s"] - WINDOW, F.lit(0)), x["e"] + WINDOW
        first = F.floor(start / PIECE).cast("int")
        held = F.array_join(F.slice(F.col("__pieces"), first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
        before = held.substr(start - first * PIECE + 1, x["s"] - start)
        after = held.substr(x["e"] - first * PIECE + 1, F.lit(WINDOW))
        whole_before = F.when(start > 0, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
        whole_after = F.when(end < F.col("__size"), F.regexp_replace(after, r"\S+$", "")).otherwise(after)
        return _terms(F.concat(whole_before, F.lit(" "), whole_after))

    found = F.concat(*(F.transform(F.col(f"__{k}"), (lambda k: lambda x: F.struct(_entity(k, x["v"]).alias("entity"), near(x).alias("near")))(k)) for k in KINDS))
    rows = based.select(F.md5("text").alias("text_key"), "row", F.explode(found).alias("f"))
    # one struct for each value of a document; its mentions' terms come together in the shuffle of narrow rows
    rows = rows.select("text_key", "row", F.col("f.entity").alias("entity"), F.explode_outer("f.near").alias("term")).distinct()
    return rows.groupBy("text_key", "entity", "term").agg(F.count(F.lit(1)).alias("copies"))


def _few(frame: DataFrame, cells: str = "1") -> DataFrame:
    """A broadcast of a materialised table if it has few cells; itself otherwise."""
    return F.broadcast(frame) if (frame.agg(F.sum(F.expr(cells))).first()[0] or 0) <= BROADCAST_ROWS else frame


def _classes(term: Column) -> tuple[Column, Column]:
    """The classes of a term, the narrower one first. No term has an asterisk."""
    return F.concat(term.substr(1, 1), F.lit("*"), F.length(term).cast("string")), F.concat(F.lit("*"), F.length(term).cast("string"))


def _share(together: Column, n: Column, n_entity: Column, total: int) -> Column:
    """The share of an entity's information that a term or class tells."""
    chance = n_entity / F.lit(float(max(total, 1)))
    rare = -F.log2(chance)
    return F.when(rare > 0, F.round(F.lit(1.0) + F.log2((together + chance) / (n + 1)) / rare, 9)).otherwise(F.lit(0.0))


def disclosures(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The mentions, and (entity, term, share, instead) of all terms that disclose an entity from GENERALISE on; instead is the class, or empty for removal."""
    near = materialise(mentions(docs, text_col), "mentions")
    of_entity = near.groupBy("entity", "text_key").agg(F.max("copies").alias("copies")).groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    of_entity = _few(materialise(of_entity, "entities"))
    pairs = near.filter("term is not null").groupBy("entity", "term").agg(F.sum("copies").alias("together"))
    pairs = materialise(pairs.join(of_entity, "entity"), "pairs")
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    counted = _terms(F.col("text"))
    classes = F.array_distinct(F.flatten(F.transform(counted, lambda t: F.array(*_classes(t)))))
    of_term = materialise(texts.select(F.explode(F.concat(counted, classes)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    total = texts.count()
    share = _share(F.col("together"), F.col("n"), F.col("n_entity"), total)
    told = materialise(pairs.join(of_term, "term").withColumn("share", share).filter(F.col("share") >= GENERALISE).select("entity", "term", "share"), "told")
    narrow, wide = _classes(F.col("term"))
    by_class = near.filter("term is not null").join(_few(told.select("entity").distinct()), "entity", "left_semi").select("text_key", "entity", "copies", F.explode(F.array(narrow, wide)).alias("class")).distinct()
    by_class = by_class.groupBy("entity", "class").agg(F.sum("copies").alias("together")).join(of_entity, "entity")
    known = _few(of_term.filter(F.col("term").contains("*")).withColumnRenamed("term", "class"))
    telling = materialise(by_class.join(known, "class").select("entity", "class", share.alias("tells")).filter(F.col("tells") < GENERALISE), "classes")
    for name, key, of in (("__narrow", "__c1", narrow), ("__wide", "__c2", wide)):
        named = telling.select("entity", F.col("class").alias(key), F.concat(F.lit("["), "class", F.lit("]")).alias(name))
        told = told.withColumn(key, of).join(named, ["entity", key], "left")
    instead = F.when(F.col("share") >= REMOVE, F.lit("")).otherwise(F.coalesce("__narrow", "__wide", F.lit("[TERM]")))
    return near, materialise(told.select("entity", "term", "share", instead.alias("instead")), "disclosures")


def _treated(docs: DataFrame, near: DataFrame, told: DataFrame, text_col: str) -> DataFrame:
    """(text_key, __words): for each text that mentions an entity, what replaces each of its terms that disclose one."""
    texts = docs.select(F.col(text_col).alias("text")).filter(_hinted())
    words = texts.select(F.md5("text").alias("text_key"), F.explode(_terms(F.col("text"))).alias("term")).join(_few(told.select("term").distinct()), "term", "left_semi").distinct()
    held = words.join(_few(told), "term").join(near.select("text_key", "entity").distinct(), ["text_key", "entity"])
    # of several entities the one that is told most; then the widest class
    strongest = F.max(F.struct(F.col("share") >= REMOVE, -F.length("instead"), "instead")).alias("m")
    by_term = held.groupBy("text_key", "term").agg(strongest).select("text_key", F.struct("term", F.col("m.instead").alias("instead")).alias("w"))
    return materialise(by_term.groupBy("text_key").agg(F.sort_array(F.collect_list("w")).alias("__words")), "treated")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, then the columns that keep names.

    keep may name ``clean``: the text with base spans replaced by [KIND], generalised
    terms by their class, such as [q*5] for a q and five letters in all, or [*5], and
    removed terms by nothing; null for a null text. Spans are
    kind:start:end in code points, by kind (email, ip, card, phone, term), then start.
    A null or empty text has none. Null ids and repeated rows are kept as they are;
    equal texts count as often as they occur. Other columns are not read and may have
    any name. No rows: no rows.
    """
    near, told = disclosures(docs, text_col)
    treated = _treated(docs, near, told, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__raw"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"), *(F.col(c) for c in keep if c != "clean"))
    rows = with_base(rows, "__t").withColumn("text_key", F.md5("__t"))
    few = _few(treated, "size(__words)")
    if few is treated:
        # too many for a broadcast: only texts with an entity are shuffled
        bearing = F.size("__email") + F.size("__ip") + F.size("__card") + F.size("__phone") > 0
        rows = rows.filter(bearing).join(treated, "text_key", "left").unionByName(rows.filter(~bearing), allowMissingColumns=True)
    else:
        rows = rows.join(few, "text_key", "left")
    # all words of the text are looked up, so that many terms cost no more than one
    find_terms, split_terms, placed = _spans("__t", F.lit(TERM), "__m", "__p")
    rows = rows.withColumn("__map", F.map_from_entries("__words"))
    rows = rows.withColumn("__m", F.when(F.size("__words") > 0, find_terms).otherwise(F.array().cast("array<string>"))).withColumn("__p", F.when(F.size("__m") > 0, split_terms))
    rows = rows.withColumn("__term", F.filter(placed, lambda x: F.element_at("__map", F.lower(x["v"])).isNotNull()))

    def listed(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    base = F.concat(*map(listed, KINDS))
    out = [F.col("doc_id").alias(id_col)] + [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    out += [F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, listed("term")), ",").alias("spans"), F.size("__term").cast("long").alias("n_term")]
    if "clean" in keep:
        out.append(F.when(F.col("__raw").isNotNull(), _clean()).alias("clean"))
    return rows.select(*out, *(c for c in keep if c != "clean"))


def _clean() -> Column:
    def tagged(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _label(kind, x["v"]).alias("v")))

    spans = F.array_sort(F.concat(*(tagged(k) for k in (*KINDS, "term"))))
    # of spans that overlap the first is replaced
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        piece = F.when(x["s"] >= acc["at"], F.concat(F.col("__t").substr(acc["at"] + 1, x["s"] - acc["at"]), x["v"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def many(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["at"].alias("at"), F.expr("cast(array() as array<string>)").alias("out")), one)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(done["out"], ""))).alias("out"))

    rebuilt = F.aggregate(_once(spans, _blocks), start, many, lambda acc: F.concat(F.array_join(acc["out"], ""), F.col("__t").substr(acc["at"] + 1, F.length("__t"))))
    return F.when(_any(), rebuilt).otherwise(F.col("__t"))


def _any() -> Column:
    found = F.size("__term")
    for kind in KINDS:
        found = found + F.size(f"__{kind}")
    return found > 0


def _label(kind: str, value: Column) -> Column:
    if kind != "term":
        return F.lit(f"[{kind.upper()}]")
    return F.element_at("__map", F.lower(value))


def sanitise(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with sanitised texts; a column of character counts follows the new text. All rows and columns stay."""
    others = F.struct(*(F.col(c) for c in docs.columns if c != text_col)).alias("__others")
    packed = docs.select(F.lit(None).cast("long").alias("__id"), F.col(text_col), others)
    clean = find(packed, "__id", text_col, ("clean", "__others"))
    columns = [F.col("clean").alias(c) if c == text_col else F.length(F.coalesce("clean", F.lit(""))).cast(docs.schema[c].dataType).alias(c) if c == count_col else F.col(f"__others.`{c}`").alias(c) for c in docs.columns]
    return clean.select(*columns)


def op1_disclosure_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op1_disclosure_terms": op1_disclosure_terms}
#: The patterns need look-behind, which DuckDB's do not have; the query is tested against a brute-force version.
ORACLES: dict[str, str] = {}
