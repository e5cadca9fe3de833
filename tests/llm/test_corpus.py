"""Operators over whole corpora: sharding, packing, near-duplicates, images, the pipeline."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from lexmill.llm import dedup, images, packing, sharding, tokenizer

ODD = [(0, None), (1, ""), (2, "x"), (None, "no id"), (None, "no id"), (3, "twice"), (3, "twice"), (4, " \n "), (5, "word " * 30000)]


def table(spark):
    return [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "'c' as shard", "1 as node", "2 as row", "3 as length")


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_feistel_permutes(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(sharding.F.col("id"), n, 20)).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or got != list(range(n)))


def test_shards(spark):
    rows = ODD + table(spark) + [(77, "hot")] * 300
    got = sharding.shard(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard(frame(spark, rows[::-1], 7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and {r.law for r in got} == {"rows"}
    assert sharding.shard(frame(spark, rows).limit(0)).count() == 0


def test_packing(spark):
    t = Tokenizer.from_file(tokenizer.tokenizer_path(tokenizer.TOKENIZER))
    rows = ODD + table(spark) + [(77, "hot")] * 300
    got = packing.pack(frame(spark, rows), keep_ids=True).collect()
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        starts = [0, *range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0


def test_plans():
    rng = random.Random(4)
    for capacity in (1, 7, 100):
        for _ in range(60):
            lengths = {k: rng.randint(1, 50) for k in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
            plan = packing.plan(lengths, capacity)
            used = Counter()
            for parts, n in plan:
                assert n > 0 and sum(parts) <= capacity
                for p in parts:
                    used[p] += n
            assert used == Counter(lengths)
    assert sum(n for _, n in packing.plan({60: 10, 30: 10, 10: 10}, 100)) == 10


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    named = [i for i, (d, _) in enumerate(rows) if d is not None]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and (sets[a] == sets[b] or a in named_set(named) and b in named_set(named) and min(len(sets[a]), len(sets[b])) * 4 >= 3 * max(len(sets[a]), len(sets[b]))):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i), None)) for i, (d, _) in enumerate(rows)), key=str)


_named = {}


def named_set(named):
    return _named.setdefault(id(named), set(named))


def test_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    drift = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = f"e{rng.randint(0, 99999)}"
        drift.append((20000 + k, " ".join(words)))
    short = [(30000, "A B c d E"), (30001, "a b C D e"), (30002, "a b c"), (30003, "a b c"), (30004, "a b c d e f")]
    rows = ODD + table(spark) + drift + short + [(40000 + k, "copied text of some more words") for k in range(200)]
    got = dedup.groups(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(rows)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)
    kept = dedup.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r.kept for r in got)
    assert dedup.groups(frame(spark, rows).limit(0)).count() == 0


def test_rows_of_buckets_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(1, 10, 10), (1, 11, 10), (2, 11, 10), (2, 12, 12), (3, 13, 13)], "key long, node long, comp long")
    got = dedup._mixed(rows.mapInArrow(count, rows.schema)).collect()
    assert sorted(tuple(r) for r in got) == [(2, 11, 10), (2, 12, 12)]
    assert made.value == rows.count()


def test_sketches_merge():
    a, b = dedup.shingle_set(" ".join(map(str, range(300)))), dedup.shingle_set(" ".join(map(str, range(200, 600))))
    import numpy as np

    assert (np.maximum(dedup.sketch(a), dedup.sketch(b)) == dedup.sketch(np.union1d(a, b))).all()


def test_images(spark):
    rng = random.Random(6)
    seeds = [bytes(rng.randrange(256) for _ in range(8)) for _ in range(40)]
    rows = [(4 * i + e, *images.drawn(s, e)) for i, s in enumerate(seeds) for e in range(4)]
    rows += [(1000, *images.drawn(seeds[0], 0)), (1001, None, 4, 4), (1002, b"", 0, 0), (1003, b"torn", 9, 9), (None, *images.drawn(seeds[1], 0)), (1004, b"\x80" * 9216, 96, 96)]
    got = {r.image_id: r for r in images.copies(spark.createDataFrame(rows, "image_id long, pixels binary, width int, height int").selectExpr("*", "1 as node")).collect()}
    together = sum(got[4 * i + e].component_id == 4 * i for i in range(40) for e in range(4))
    apart = len({got[4 * i].component_id for i in range(40)})
    assert together >= 0.95 * 160 and apart == 40
    assert got[1000].component_id == 0 and got[None].component_id == 4 and all(got[k].component_id == k and not got[k].n_links for k in (1001, 1002, 1003, 1004))
    assert images.copies(spark.createDataFrame([], "image_id long, pixels binary, width int, height int")).count() == 0


def variants(image):
    """Crops to a half and a quarter of the area, turns, other sizes."""
    np, n = images.np, image.shape[0]
    h = int(n * 0.707)
    small = image.reshape(n // 2, 2, n // 2, 2).mean((1, 3)).astype("u1")
    return [image, image[n - h :, n - h :], image[n // 5 : n // 5 + n // 2, n // 7 : n // 7 + n // 2], np.rot90(image), np.rot90(image, 2), small, image.repeat(2, 0).repeat(2, 1)]


def test_crops_turns_and_sizes(spark):
    rows = []
    for k in range(6):
        pixels, w, h = images.drawn(bytes([k, 1]), 0, 256)
        for e, v in enumerate(variants(images.np.frombuffer(pixels, "u1").reshape(h, w))):
            rows.append((10 * k + e, v.tobytes(), v.shape[1], v.shape[0]))
    got = images.copies(spark.createDataFrame(rows, "image_id long, pixels binary, width int, height int").repartition(8)).collect()
    assert {r.image_id: r.component_id for r in got} == {i: i // 10 * 10 for i, *_ in rows}


def test_images_against_all_pairs(spark):
    rows = [(k, *images.drawn(bytes([k // 4, 2]), k % 4)) for k in range(200)]
    points = [images.keypoints(*r[1:]) for r in rows]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(200):
        for b in range(a):
            if images.agree(points[b], points[a]) >= images.INLIERS:
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = images.copies(spark.createDataFrame(rows, "image_id long, pixels binary, width int, height int").repartition(8)).collect()
    assert {r.image_id: r.component_id for r in got} == {k: find(k) for k in range(200)}


def test_bands_and_blocks(monkeypatch):
    picture = images.drawn(b"bands", 0, 192)
    whole = images.keypoints(*picture)
    half = images.keypoints(images.np.frombuffer(picture[0], "u1").reshape(192, 192)[:, 96:].tobytes(), 96, 192)
    links = images.agree(whole, half)
    monkeypatch.setattr(images, "BAND", 500)
    monkeypatch.setattr(images, "PAIRS", 300)
    assert (images.keypoints(*picture) == whole).all() and images.agree(whole, half) == links >= images.INLIERS


def test_large_groups_of_images(spark):
    rows = []
    for k in range(4096):
        image = images.np.frombuffer(images.drawn(b"large", 0)[0], "u1").reshape(96, 96).copy()
        image[0, k % 64], image[95, k // 64] = 1, 2  # outside of all patches
        rows.append((k, image.tobytes(), 96, 96))
    got = images.copies(spark.createDataFrame(rows, "image_id long, pixels binary, width int, height int").repartition(8)).collect()
    parts = len({r.component_id for r in got})
    assert len(got) == 4096 and parts == 1, parts


def test_crowded_buckets_of_images(spark, monkeypatch):
    """Forty pairs of copies whose parts all stand in the same buckets of eighty images."""
    np, rng = images.np, images.np.random.Generator(images.np.random.PCG64(3))

    def corners(bits):
        points = np.zeros(len(bits), images.POINT)
        points["x"], points["y"], points["size"], points["bits"] = rng.integers(0, 9000, len(bits)), rng.integers(0, 9000, len(bits)), 1, bits
        return points

    bits = rng.integers(0, 256, (6, images.BITS // 8), dtype=np.uint8)
    points = [corners(bits) for _ in range(40) for _ in range(2)]
    for k in range(0, 80, 2):
        points[k + 1]["x"], points[k + 1]["y"] = points[k]["x"] + 5, points[k]["y"]
    by = {bytes([k]): x for k, x in enumerate(points)}
    monkeypatch.setattr(images, "_described", lambda held: spark.createDataFrame([(r.node, by[bytes(r.pixels)].tobytes(), 6, True) for r in held.collect()], "node long, points binary, n long, same boolean"))
    got = images.copies(spark.createDataFrame([(k, bytes([k]), 1, 1) for k in range(len(points))], "image_id long, pixels binary, width int, height int")).collect()
    assert {r.image_id: r.component_id for r in got} == {k: k // 2 * 2 for k in range(80)}


def test_pairs_of_images_at_once():
    np, rng = images.np, images.np.random.Generator(images.np.random.PCG64(8))
    held = [images.keypoints(*images.drawn(bytes([k // 4, 5]), k % 4, 96 if k < 40 else 160)) for k in range(60)]
    held = [x[: rng.integers(6, len(x) + 1)] for x in held]
    i, j = np.nonzero(np.ones((60, 60), bool))
    want = [images.agree(held[a], held[b]) >= images.INLIERS for a, b in zip(i, j, strict=True)]
    assert images.agreeing(held, images._padded(held), i, j).tolist() == want and sum(want) > 60
    keys = [set(images._keys([x])[0].tolist()) for x in held]
    found = [pair for p in images.candidates(held[:25], held[25:]) for pair in zip(*(z.tolist() for z in p), strict=True)]
    assert sorted(found) == [(a, b) for a in range(25) for b in range(35) if len(keys[a] & keys[25 + b]) >= images.VOTES]


def test_ties_and_all_candidates_of_an_image_at_once(monkeypatch):
    """Equal corners, which are nearest to several, link as in agree(); two thousand candidates of one image are compared in one part."""
    np, rng = images.np, images.np.random.Generator(images.np.random.PCG64(12))
    held = []
    for k in range(60):
        one = images.keypoints(*images.drawn(bytes([k // 3, 7]), k % 3)).copy()
        to = rng.integers(0, len(one), (2, 6))
        one["bits"][to[0]] = one["bits"][to[1]]
        held.append(one)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60), indexing="ij"))
    want = [images.agree(held[a], held[b]) >= images.INLIERS for a, b in zip(i, j, strict=True)]
    assert images.agreeing(held, images._padded(held), i, j).tolist() == want and 60 < sum(want) < 600
    parts, mutual = [], images._mutual
    monkeypatch.setattr(images, "_mutual", lambda one, two: parts.append(two.shape[2]) or mutual(one, two))
    same = [x for x in held if len(x) > 16][:40] * 50
    images.agreeing(same, images._padded(same), np.zeros(2000, np.int64), np.arange(2000))
    assert parts == [2000]


def test_one_image_with_many_at_once(monkeypatch):
    """The same links whether pairs of one image are compared together, with the other pairs, or in small parts."""
    np = images.np
    held = [images.keypoints(*images.drawn(bytes([k // 4, 6]), k % 4, 96 if k < 60 else 128)) for k in range(80)]
    held = [x[: 24 - k % 3] for k, x in enumerate(held)]
    i, j = (x.ravel() for x in np.indices((80, 80)))
    want = [images.agree(held[a], held[b]) >= images.INLIERS for a, b in zip(i, j, strict=True)]
    assert 80 < sum(want) < 6400
    for run, tested in ((1, images.TESTED), (1 << 20, images.TESTED), (30, 5000)):
        monkeypatch.setattr(images, "RUN", run)
        monkeypatch.setattr(images, "TESTED", tested)
        mixed = np.random.Generator(np.random.PCG64(1)).permutation(len(i))
        got = np.empty(len(i), bool)
        got[mixed] = images.agreeing(held, images._padded(held), i[mixed], j[mixed])
        assert got.tolist() == want


def told_by(held):
    return images.information(*images.np.unique(images._keys(held)[0], return_counts=True), len(held), images.np.concatenate(held))


def found_by(*sides):
    return {pair for p in images.candidates(*sides) for pair in zip(*(z.tolist() for z in p), strict=True)}


def test_candidates_that_tell_enough():
    """Of the pairs with three parts in common few need to be compared, and those that agree are among them."""
    held = [images.keypoints(*images.drawn(bytes([k // 4, 9]), k % 4)) for k in range(320)]
    told = told_by(held + [images.keypoints(*images.drawn(bytes([k % 250, k // 250, 1]), 0)) for k in range(1000)])
    left, right = held[::2], held[1::2]
    plain, fewer = found_by(left, right), found_by(left, right, told)
    both = sorted(plain | fewer)
    i, j = images.np.array(both).T
    linked = {pair for pair, ok in zip(both, images.agreeing(held, images._padded(held), 2 * i, 2 * j + 1), strict=True) if ok}
    assert len(linked) > 300 and linked <= fewer and 5 * len(fewer) < len(plain)
    assert {(a // 2, b // 2) for a, b in found_by(held, held, told) if a % 2 == 0 and b % 2} == fewer


def test_common_parts_at_the_same_places():
    """Parts that all images have tell nothing, but two corners that stand to each other in the same way do."""
    np, rng = images.np, images.np.random.Generator(images.np.random.PCG64(4))
    bits = rng.integers(0, 256, (6, images.BITS // 8), dtype=np.uint8)
    left, right = [], []
    for _ in range(40):
        one = np.zeros(6, images.POINT)
        one["x"], one["y"], one["size"], one["bits"] = rng.integers(0, 9000, 6), rng.integers(0, 9000, 6), 1, bits
        two = one[::-1].copy()
        two["x"], two["y"], two["size"], two["angle"] = 2 * (90 - one["y"][::-1]), 2 * (one["x"][::-1] + 5), 2, np.pi / 2
        left.append(one)
        right.append(two)
    told = told_by(left + right)
    assert not told[1].any() and found_by(left, right, told) == {(k, k) for k in range(40)}


def test_copies_by_what_parts_tell(spark, monkeypatch):
    rows = [(k, *images.drawn(bytes([k // 4, 2]), k % 4)) for k in range(120)]
    table = spark.createDataFrame(rows, "image_id long, pixels binary, width int, height int").repartition(8)
    plain = {r.image_id: r.component_id for r in images.copies(table).collect()}
    asked, told = [], images._told
    monkeypatch.setattr(images, "PLAIN", 100)
    monkeypatch.setattr(images, "_told", lambda nodes: asked.append(told(nodes)) or asked[-1])
    assert {r.image_id: r.component_id for r in images.copies(table).collect()} == plain
    assert len(asked[0][0]) and abs(asked[0][2] / images.EACH - images.np.log(120 / images.RARE)) < 0.01


def test_pipeline(spark):
    import corpus_pipeline
    from lexmill.llm import pii
    from lexmill.session import materialise
    from tests.llm.test_pii import base
    from tests.llm.test_rows import brute_quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = [r for r in rows if brute_quality(*r)[-1]]
    first = materialise(corpus_pipeline.keep_quality(spark, docs, ""), "t")
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, _ in good) and first.columns == docs.columns
    kept = {c for _, _, c in brute_groups(good)}
    second = materialise(corpus_pipeline.drop_near_duplicates(spark, first, ""), "t")
    assert {r.doc_id for r in second.collect()} == kept and second.columns == docs.columns
    third = materialise(corpus_pipeline.remove_private(spark, second, ""), "t")
    texts = dict(good)
    for r in third.collect():
        assert r.n_chars == len(r.text) and not any(v in r.text for _, _, _, v in base(texts[r.doc_id]))
    assert third.columns == docs.columns and third.count() == len(kept) and pii.KINDS
    fourth = corpus_pipeline.pack_sequences(spark, third, "")
    assert {r.doc_id for r in fourth.select("doc_id").distinct().collect()} == kept
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "private", "packing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == fourth.count()
