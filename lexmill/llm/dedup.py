"""Near-duplicate documents by SetSketch registers, confirmed on full shingle sets.

1. A document's set is its distinct five-word shingles, as 64-bit hashes. Its sketch
   has REGISTERS registers: the minimum of an exponential variate over the set, scaled
   by powers of BASE and truncated to a byte. Sketches merge by maximum. Documents with
   equal sets are one node from here on.
2. Each of BANDS bands of WIDTH registers puts a node in a bucket. A bucket's
   representative is its smallest node, in one of ORDERS orders by the band, so that
   members of a large group meet different representatives. Candidates are (member,
   representative): linear in the members, however large a bucket is. Buckets of three
   have a second one, after which all their pairs are candidates.
3. Sketches estimate the similarity of a candidate jointly, by the likelihood of the
   counts of larger, equal and smaller registers; candidates far below the threshold
   go. Each member's best ones are confirmed on full sets; of the others, those whose
   ends are not connected by then. Confirmed links are joined to components.
4. Buckets whose members besides the representative are still in several components
   are compared inside, exactly. First go the nodes that can have no link there: those
   of whose shingles too few occur in any other such node. The rest falls into groups
   that share buckets. Nodes outside of a group's largest component are compared with
   all of the group, in blocks of bounded size, each node once in a block and not once
   for each bucket; groups that hang together loosely go by bucket. So no link between
   two nodes that share a bucket gets lost.

A pair at the threshold shares no bucket with a chance of about 6e-7. Sets are made
only for nodes with a likely candidate or in a bucket of step 4. Components are found by
alternating large-star and small-star steps over edges in the shared scratch folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.session import materialise, small_batches
from lexmill.sources.tables import table

SHINGLE = 5
THRESHOLD = 75
BANDS, WIDTH, REGISTERS = 48, 5, 256
BASE, RATE, TOP = 1.125, 20.0, 255
#: Different orders of nodes that choose representatives.
ORDERS = 2
#: Candidates whose estimated similarity is below this are not confirmed: 3.9 standard errors under the threshold.
CUT = 0.645
#: Best candidates of a member that are confirmed first.
FIRST = 2
#: Rows of a block in an exact comparison, bytes of its sets, and shingles that are multiplied at once.
BLOCK, BLOCK_BYTES, COLUMNS = 1000, 16 << 20, 4096
#: Rows of two numbers up to this many are broadcast (about 40 MB in memory); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
WORDS = 200_000

_rng = np.random.Generator(np.random.PCG64(20))
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_words: dict[bytes, int] = {}


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)][: bool(n)], np.uint64)
    hashes = list(map(_words.get, words))
    if None in hashes:
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = h = xxhash.xxh64_intdigest(words[i])
                if len(_words) < WORDS and len(words[i]) < 64:
                    _words[words[i]] = h
    w = np.fromiter(hashes, np.uint64, n)
    total = w[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        total += w[k : n - SHINGLE + 1 + k] * _PLACE[k]
    total ^= total >> np.uint64(32)
    return np.unique(total)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes."""
    small = (hashes ^ (hashes >> np.uint64(29))).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    buffer = np.empty((REGISTERS, min(256, len(small) or 1)), np.uint32)
    for at in range(0, len(small), 256):
        part = small[at : at + 256]
        held = buffer[:, : len(part)]
        np.bitwise_xor(part[None, :], _XOR, out=held)
        np.multiply(held, _MUL, out=held)
        np.minimum(least, held.min(axis=1), out=least)
    x = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint8)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1.0) / BASE) / np.log(BASE)


def likely(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the maximum-likelihood similarity is at least CUT, given register comparisons and set sizes.

    The log-likelihood is concave in the similarity, so its slope at the cut decides. Sizes alone bound the similarity from above.
    """
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    fits = np.minimum(u, v) * 100 >= np.maximum(u, v) * THRESHOLD - 1e-9
    at = np.minimum(CUT, np.minimum(u / v, v / u) * (1 - 1e-9))
    step = 1e-6

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        up, down = _share(u - v * j), _share(v - u * j)
        equal = REGISTERS - larger - smaller
        tiny = 1e-300
        return larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1.0 - up - down, tiny))

    return fits & (log_likelihood(at) >= log_likelihood(at - step))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, digest of the set and sketch; digest and sketch of an empty set are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, held = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                held.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(held, pa.binary())], ["doc_id", "n", "digest", "sketch"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, n long, digest binary, sketch binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) for every band of every node."""
    places = np.int64(256) ** np.arange(WIDTH, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH).astype(np.int64)
            keys = (m @ places) + (np.arange(BANDS, dtype=np.int64) << 40)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long")


def _salt(key: Column) -> Column:
    """An order of nodes, one of ORDERS by the band: an exclusive or with a number of its own."""
    return F.xxhash64(F.shiftright(key, 40) % ORDERS).bitwiseAND(F.lit((1 << 62) - 1))


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (node, rep) that are likely similar, with the number of equal registers."""
    info = nodes.select("node", "n", "sketch")
    joined = pairs.join(info, "node").join(info.select(F.col("node").alias("rep"), F.col("n").alias("rep_n"), F.col("sketch").alias("rep_sketch")), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            a, b = _matrix(col["sketch"]), _matrix(col["rep_sketch"])
            larger, smaller = (a > b).sum(1), (a < b).sum(1)
            ok = likely(larger, smaller, col["n"].to_numpy(), col["rep_n"].to_numpy())
            out = pa.RecordBatch.from_arrays([col["node"], col["rep"], pa.array((REGISTERS - larger - smaller).astype(np.int32))], ["node", "rep", "same"])
            yield out.filter(pa.array(ok))

    return joined.select("node", "rep", "n", "rep_n", "sketch", "rep_sketch").mapInArrow(run, "node long, rep long, same int")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (node, rep) whose full sets are linked."""
    pairs = pairs.select("node", "rep")
    joined = pairs.join(sets.select("node", "shingles"), "node").join(sets.select(F.col("node").alias("rep"), F.col("shingles").alias("rep_shingles")), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ok = []
            for a, b in zip(col["shingles"], col["rep_shingles"], strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                ok.append(100 * common >= THRESHOLD * (len(x) + len(y) - common))
            out = pa.RecordBatch.from_arrays([col["node"], col["rep"]], ["node", "rep"])
            yield out.filter(pa.array(ok, pa.bool_()))

    return joined.select("node", "rep", "shingles", "rep_shingles").mapInArrow(run, "node long, rep long")


def components(links: DataFrame, a: str = "node", b: str = "rep") -> DataFrame:
    """(node, comp) for every node of a link: comp is the smallest node reachable. Alternating large-star and small-star steps."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u <> v").distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 30) - 1)))).first()
        if mark == now:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: components of components, of which few are joined."""
    ends = _label(_label(links, labels, "node", "__a"), labels, "rep", "__b").filter("__a <> __b")
    moved = materialise(components(ends.select(F.col("__a").alias("node"), F.col("__b").alias("rep"))), "moved")
    held = labels.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("__to")), "comp", "left").select("node", F.coalesce("__to", "comp").alias("comp"))
    return materialise(held.union(moved.join(labels.select("node"), "node", "left_anti").select("node", "comp")), "labels")


def _label(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the component of column node, which is the node itself if it has no link."""
    known = labels.select(F.col("node").alias(node), F.col("comp").alias("__comp"))
    return rows.join(known, node, "left").withColumn(name, F.coalesce("__comp", node)).drop("__comp")


def _crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return _label(_label(pairs, labels, "node", "__a"), labels, "rep", "__b").filter("__a <> __b").select("node", "rep")


def _few_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the ends of pairs."""
    ends = materialise(pairs.select("node").union(pairs.select("rep")).distinct(), "ends")
    return sets.join(_few(ends), "node", "left_semi")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, node, comp) of buckets with several components. Rows are written first, since they are read twice."""
    rows = materialise(rows, "labelled")
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(_few(materialise(several, "several")), "key", "left_semi")


def _linkable(sets: DataFrame) -> DataFrame:
    """(node, n) of nodes that have a share of THRESHOLD of their shingles in common with the others: no other node can have a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), np.uint64).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *held])), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in held]))], ["shingle", "node"])

    held = sets.select("node", "shingles").mapInArrow(run, "shingle long, node long")
    alone = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sized = sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    return sized.join(alone, "node", "left").filter((F.col("n") - F.coalesce("alone", F.lit(0))) * 100 >= F.col("n") * THRESHOLD).select("node", "n")


def _units(rows: DataFrame) -> DataFrame:
    """(unit, node, comp) from rows (key, node, comp): a unit is a group of nodes that share buckets, or one bucket of a group with fewer pairs in its buckets than in all."""
    first = materialise(rows.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("g")), "firsts")
    together = materialise(components(rows.join(_few(first), "key").select("node", F.col("first").alias("rep"))), "together")
    size = together.groupBy("comp").agg(F.count(F.lit(1)).cast("double").alias("size"))
    buckets = first.join(_few(together.withColumnRenamed("node", "first")), "first").select("key", F.col("comp").alias("group"), "g")
    pairs = buckets.groupBy("group").agg(F.sum(F.col("g").cast("double") * F.col("g")).alias("pairs"))
    loose = size.join(pairs, F.col("comp") == F.col("group")).select("group", (F.col("size") * F.col("size") > F.col("pairs")).alias("loose"))
    unit = F.when(F.col("loose"), F.col("key")).otherwise(-1 - F.col("group"))
    named = materialise(buckets.join(loose, "group").select("key", unit.alias("unit")), "named")
    return rows.join(_few(named), "key").select("unit", "node", "comp").distinct()


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (node, rep) between different components within units; one for each two components of a block."""
    by_comp = rows.groupBy("unit", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    of_unit = by_comp.groupBy("unit").agg(F.max(F.struct("c", "comp", "n")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"))

    def blocks(c: Column, n: Column) -> Column:
        return F.greatest(F.ceil(c / F.lit(BLOCK)), F.ceil(n * 8 / F.lit(BLOCK_BYTES)))

    of_unit = of_unit.select("unit", F.col("top.comp").alias("main"), blocks(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("outer"), blocks(F.col("top.c"), F.col("top.n")).alias("inner"))
    rows = rows.join(_few(materialise(of_unit, "blocks")), "unit").withColumn("out", F.col("comp") != F.col("main"))
    # units of one block of either kind meet once; larger ones are dealt to all pairs of blocks with an outsider's block
    zero = F.lit(0).cast("long")
    small = rows.filter("outer + inner <= 2").select("unit", "node", "comp", "out", zero.alias("own"), zero.alias("x"), zero.alias("y"))
    own = F.when(F.col("out"), F.pmod(F.xxhash64("node"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("node"), F.greatest(F.col("inner"), F.lit(1))))
    last = F.when(F.col("out"), F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1)
    large = rows.filter("outer + inner > 2").select("unit", "node", "comp", "out", own.cast("long").alias("own"), F.explode(F.sequence(zero, last.cast("long"))).alias("other"))
    dealt = small.unionByName(large.select("unit", "node", "comp", "out", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))

    def run(held: pa.Table) -> pa.Table:
        node, comp, own, out = (held.column(c).to_numpy() for c in ("node", "comp", "own", "out"))
        x, y = held.column("x")[0].as_py(), held.column("y")[0].as_py()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        if x == y:
            left = left[out[left].astype(bool)]
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in held.column("shingles")]
        both = common(sets, left, right)
        n = np.array(list(map(len, sets)), np.int64)
        linked = (100 * both >= THRESHOLD * (n[left][:, None] + n[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
        i, j = np.nonzero(linked)
        p, q = left[i], right[j]
        ends = np.sort(np.stack([comp[p], comp[q]], 1), 1)
        one = np.unique(ends, axis=0, return_index=True)[1]
        return pa.table({"node": node[p[one]], "rep": node[q[one]]})

    return dealt.join(sets.select("node", "shingles"), "node").groupBy("unit", "x", "y").applyInArrow(run, "node long, rep long").distinct()


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets: a matrix of those numbered left and right, by products of 0/1 matrices, COLUMNS shingles at once."""
    shingles, place, count = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    shared = count[place] > 1
    place, owner = (np.cumsum(count > 1) - 1)[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(left), len(right)), np.float32)
    rows = np.zeros((len(sets), COLUMNS), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        lo, hi = np.searchsorted(place, (at, at + COLUMNS))
        rows[:] = 0
        rows[owner[lo:hi], place[lo:hi] - at] = 1
        total += rows[left] @ rows[right].T
    return np.rint(total).astype(np.int64)


def _rest(docs: DataFrame, members: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """Links between different components within the buckets of four members and more, none of them a representative's."""
    rows = materialise(_mixed(_label(members.filter("more and node <> rep").select("key", "node"), labels, "node", "comp")), "mixed")
    if rows.isEmpty():
        return None
    asked = materialise(rows.select("node").distinct(), "asked")
    new = _sets(docs, nodes, asked.join(sets.select("node"), "node", "left_anti"), id_col, text_col)
    sets = sets.join(_few(asked), "node", "left_semi").unionByName(new)
    linkable = materialise(_linkable(sets), "linkable")
    rows = materialise(_mixed(rows.join(_few(linkable.select("node")), "node", "left_semi")), "linkable-rows")
    if rows.isEmpty():
        return None
    units = materialise(_units(rows).join(_few(linkable), "node"), "units")
    return materialise(_compared(units, sets), "links")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and kept.

    A null or empty text, or one of white space, has an empty set, is linked with
    nothing and is its own component. Equal texts, and repeated rows, are linked with
    each other. A row without id is linked only with rows of an equal set and never
    names a component; if none of those has an id, its component_id is null, and it is
    kept, since nothing can stand for it. Other columns are not read and may have any name. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    held = materialise(sketches(docs, id_col, text_col), "sketches")
    distinct = held.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("n", "sketch")).alias("s"))
    nodes = materialise(distinct.select(F.monotonically_increasing_id().alias("node"), "digest", "first_id", "s.n", "s.sketch"), "nodes")
    members = _members(nodes)
    stars = materialise(_estimated(_candidates(members), nodes), "stars")
    sets = _sets(docs, nodes, stars.select("node").union(stars.select("rep")).distinct(), id_col, text_col)
    ranked = stars.withColumn("__at", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("same"), "rep")))
    links = materialise(_confirmed(ranked.filter(F.col("__at") <= FIRST), sets), "links")
    labels = materialise(components(links), "labels")
    crossing = materialise(_crossing(ranked.filter(F.col("__at") > FIRST), labels), "crossing")
    labels = _merged(labels, materialise(_confirmed(crossing, _few_sets(crossing, sets)), "links"))
    rest = _rest(docs, members, nodes, labels, sets, id_col, text_col)
    if rest is not None and not rest.isEmpty():
        labels = _merged(labels, rest)
    named = labels.join(nodes.select("node", "digest", "first_id"), "node")
    ids = materialise(named.groupBy("comp").agg(F.min("first_id").alias("component")), "components")
    by_digest = named.join(_few(ids), "comp").select("digest", F.col("component").alias("linked"))
    alone = nodes.select("digest", "first_id").join(materialise(by_digest, "linked"), "digest", "left").select("digest", F.coalesce("linked", "first_id").alias("component"))
    joined = held.select("doc_id", "n", "digest").join(alone, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, rep, last, more) of buckets of two nodes and more; last is the second representative of a bucket of three, more tells larger ones."""
    keyed, place = _buckets(nodes), F.col("node").bitwiseXOR(_salt(F.col("key")))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.min(place).alias("lo"), F.max(place).alias("hi")).filter("g > 1")
    at = _salt(F.col("key"))
    buckets = buckets.select("key", F.col("lo").bitwiseXOR(at).alias("rep"), F.when(F.col("g") == 3, F.col("hi").bitwiseXOR(at)).alias("last"), (F.col("g") > 3).alias("more"))
    return materialise(keyed.join(_few(materialise(buckets, "buckets")), "key"), "members")


def _candidates(members: DataFrame) -> DataFrame:
    """Distinct (node, rep) of members and their buckets' representatives."""
    others = members.filter("node <> rep")
    second = others.filter("node <> last").select(F.greatest("node", "last").alias("node"), F.least("node", "last").alias("rep"))
    return others.select("node", "rep").union(second).distinct()


def _few(frame: DataFrame) -> DataFrame:
    """A broadcast of a narrow materialised table if it is small enough; itself otherwise."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_IDS else frame


def _sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the nodes asked for, from the texts of their first documents."""
    wanted = materialise(nodes.select("node", "digest", F.col("first_id").alias("doc_id")).join(asked, "node"), "wanted")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    again = materialise(ids.join(_few(wanted.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("again")), "again")
    wanted = materialise(wanted.join(_few(again), "doc_id", "left"), "wanted")
    texts = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").join(_few(wanted), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, again, digest, text = batch.columns
            sets, ok = [], []
            for t, d in zip(text, digest, strict=True):
                s = shingle_set(t.as_py())
                ok.append(len(s) > 0 and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d.as_py())
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([node, again, pa.array(sets, pa.binary())], ["node", "again", "shingles"]).filter(pa.array(ok, pa.bool_()))

    held = materialise(texts.select("node", "again", "digest", "text").mapInArrow(run, "node long, again boolean, shingles binary"), "sets")
    if again.isEmpty():
        return held.select("node", "shingles")
    # ids that stand in several rows: their texts may be equal, too
    once = held.filter("again").select("node", "shingles").dropDuplicates(["node"])
    return held.filter("again is null").select("node", "shingles").union(materialise(once, "once"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that groups() keeps, with all their columns."""
    gone = materialise(groups(docs, id_col, text_col).filter("not kept").select(id_col).distinct(), "dropped")
    return docs.join(_few(gone), id_col, "left_anti").select(*docs.columns)


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op4_setsketch_dedup": op4_setsketch_dedup}
#: A set-similarity join over all documents is too slow in plain SQL; the query is tested against brute force.
ORACLES: dict[str, str] = {}
