"""Centroid clusters, near-duplicates by fingerprint and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import clustering, common, resample, vptree

DOCS = "doc_id long, text string"


def plain_clusters(rows, k, rounds, width, scale, seed):
    """``rows``: (id, vector); Lloyd's rounds in Python's whole numbers."""
    kept = [
        (i, [math.floor(x * scale) for x in v]) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    seeds = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        homes = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), home in zip(kept, homes) if home == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own)]
    return sorted((i is None, i or 0, near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in kept), centroids


@pytest.mark.parametrize("kind", ["near", "ties", "huge", "odd", "few"])
def test_clusters_equal_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 4)) * 3
    rows = [(i, [float(x) for x in middles[i % 6] + rng.normal(size=4) * 0.4]) for i in range(300)]
    if kind == "ties":
        rows = [(i % 90, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(300)]
    if kind == "huge":
        rows = rows[:60] + [(1000 + i, [1e30 * i, -1e300, 5e17, 0.1]) for i in range(4)]
    if kind == "odd":
        rows = rows[:50] + [
            (None, rows[0][1]), (None, [0.0] * 4), (3, rows[3][1]), (60, None), (61, []), (62, [1.0, None, 1.0, 1.0]),
            (63, [1.0, math.nan, 1.0, 1.0]), (64, [math.inf, 1.0, 1.0, 1.0]), (65, [1.0] * 5),
        ]
    if kind == "few":
        rows = rows[:3]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash"))
    found = clustering.centroid_clusters(df, k=5, rounds=6, width=4, scale=100.0)
    want, centroids = plain_clusters(rows, 5, 6, 4, 100.0, 3)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.assigned.collect())
    assert got == want and found.centroids == centroids


def test_drift_bounds_hold_and_save_scans():
    rng = np.random.default_rng(8)
    tighter = 0
    for _ in range(200):
        old = rng.integers(-300, 300, (4, 3))
        new = old + rng.integers(-90, 90, (4, 3))
        radius = [float(r) for r in rng.integers(1, 200, 4)]
        moved = clustering.drift(old.tolist(), new.tolist(), radius)
        for a in range(4):
            way = rng.normal(size=(400, 3))
            x = old[a] + way / np.linalg.norm(way, axis=1)[:, None] * radius[a] * rng.random((400, 1))
            for j in set(range(4)) - {a}:
                nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert (nearer <= moved.others[a] + 1e-9).all()
            tighter += moved.others[a] < 0.99 * max(moved.own[j] for j in range(4) if j != a)
    assert tighter > 100

    middles = rng.normal(size=(8, 16)) * 500
    x = np.floor(middles[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 60)
    centroids = [[int(v) for v in row] for row in x[:8]]
    cluster, upper, lower = clustering.scan(x, centroids)
    scanned = 0
    for _ in range(8):
        new = [[int(v) for v in np.floor(x[cluster == c].mean(axis=0))] if (cluster == c).any() else centroids[c] for c in range(8)]
        radius = [float(upper[cluster == c].max(initial=0)) for c in range(8)]
        moved = clustering.drift(centroids, new, radius)
        centroids = new
        cluster, upper, lower, n = clustering.follow(x, cluster, upper, lower, centroids, moved)
        scanned += n
        assert (cluster == clustering.scan(x, centroids)[0]).all()
    assert scanned < 0.5 * 8 * len(x)


def test_limbs_keep_sums_whole():
    for v in (0, 1, -1, 2**40, -(2**40) - 5, 3**90, -(7**55)):
        assert sum(part << (clustering.LIMB * i) for i, part in enumerate(clustering.limbs(v))) == v


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, within):
    near = {i: {i} for i in range(len(ids))}
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= within:
                group = near[i] | near[j]
                for m in group:
                    near[m] = group
    return [min((ids[m] for m in near[i] if ids[m] is not None), default=None) for i in range(len(ids))]


def near_texts():
    rng = random.Random(4)
    words = [w + str(i) for i in range(300) for w in ("A", "é", "zz")]
    texts = [None, "", "  \t", "one", "One two", "ONE", "\U0001f600 \x01 É"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(6):
            copy = list(base)
            copy[rng.randrange(400)] = rng.choice(words)
            texts.append(" ".join(copy))
        texts += [texts[-1], " ".join(base).upper().replace("É", "é")]
    return texts


@pytest.mark.parametrize("leaf_rows, block_rows", [(8192, 10**6), (4, 10**6), (16, 3)])
def test_simhash_components_equal_brute_force(spark, leaf_rows, block_rows):
    rows = [(i, t) for i, t in enumerate(near_texts())] + [(None, "one"), (None, "no other such text"), (3, "something else")]
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("clash").alias(c) for c in ("node", "leaf", "fingerprint", "root")])
    got = vptree.simhash_components(df, leaf_rows=leaf_rows, block_rows=block_rows).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = collections.Counter(
        (i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components([i for i, _ in rows], prints, 2))
    )
    assert collections.Counter(map(tuple, got)) == want


def test_fingerprints_of_long_texts_by_slices(spark):
    text = "Aa bé c " * 3000 + "x" * 5000 + " end"
    assert vptree.fingerprint(text) == plain_fingerprint(text)
    data = text.encode().lower()
    words = data.split()
    for size in (1, 7, 100, 10**9):
        runs = list(common.word_slices(data, 2, size))
        assert [w for run, old in runs for w in run[old:]] == words
        assert [tuple(run[i : i + 3]) for run, _ in runs for i in range(len(run) - 2)] == list(zip(words, words[1:], words[2:]))


def test_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    spread = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 1500), dtype=np.uint64)
    crowd = np.uint64(77) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 20, (3, 2500), dtype=np.uint64), axis=0)
    values = np.unique(np.concatenate([spread, spread ^ flips[0], spread ^ flips[1] ^ flips[2], crowd]))
    alike = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    roots = np.arange(len(values))
    while True:
        lower = np.array([roots[row].min() for row in alike])
        if (lower == roots).all():
            break
        roots = lower
    groups = vptree.Groups(values)
    groups.search(2)
    found = np.array([groups.find(i) for i in range(len(values))])
    assert (pd.factorize(found)[0] == pd.factorize(roots)[0]).all()

    tree = vptree.Tree(values[::3], 40, 2)
    assert tree.leaves > 8
    together = np.zeros_like(alike)
    dealt = 0
    for _, part in tree.deal(values):
        at = np.searchsorted(values, part)
        together[np.ix_(at, at)] = True
        dealt += len(at)
    assert together[alike].all() and dealt < 0.6 * tree.leaves * len(values)


def plain_draw(docs, target, parts=5, of=100, least=20):
    def runs(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for counts, texts in ((s, [text for _, text in docs]), (t, target)):
        for text in texts:
            counts.update(runs(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n_words, found = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((i, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((-r[4], r[0] is None, r[0] or 0, r[2], r[1]) for r in rows if r[1] >= least)
    ranks = collections.defaultdict(list)
    for rank, key in enumerate(may[: parts * len(may) // of], 1):
        ranks[key].append(rank)
    out = []
    for r in rows:
        waiting = ranks.get((-r[4], r[0] is None, r[0] or 0, r[2], r[1])) if r[1] >= least else None
        out.append((*r, waiting.pop(0) if waiting else None))
    return collections.Counter(out)


@pytest.mark.parametrize("parts", [0, 5, 50, 100])
def test_draw_equals_brute_force(spark, parts):
    rng = random.Random(6)
    words = ["The", "größe", "cat", "x1", "—", "a_b", "and", "zoo", "Über", "end"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(150)]
    docs += [(7, docs[7][1])] * 40 + [(None, docs[9][1]), (None, docs[9][1]), (200, None), (201, ""), (None, None)]
    target = [" ".join(rng.choices(words[:4], k=30)) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame(docs, DOCS).select("*", *[F.lit("clash").alias(c) for c in ("score", "rank", "_id", "weight")])
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.importance_resample(df, aim, parts=parts).collect()
    assert collections.Counter(map(tuple, got)) == plain_draw(docs, target, parts)
    drawn = sorted(r["rank"] for r in got if r["rank"])
    assert drawn == list(range(1, len(drawn) + 1))


def test_drawn_rows_come_whole(spark):
    docs = [(i, f"word{i % 7} and more " * 10, f"draw {i}") for i in range(60)] + [(None, "word1 and more " * 10, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, draw string").withColumn("_id", F.lit("clash"))
    aim = spark.createDataFrame([("word3 and more",)], "text string")
    want = {r["doc_id"]: r["rank"] for r in resample.importance_resample(df, aim, parts=20).collect() if r["rank"]}
    got = resample.drawn_rows(df, aim, parts=20).collect()
    assert {r["doc_id"]: r["draw_"]["rank"] for r in got} == {i: n for i, n in want.items() if i is not None}
    assert all((r["doc_id"], r["text"], r["draw"], r["_id"]) == (*docs[r["doc_id"]], "clash") for r in got) and len(got) >= 11


def test_draw_with_an_empty_target(spark):
    docs = [(i, f"word{i} " * 30) for i in range(20)]
    got = resample.importance_resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "text string"))
    assert collections.Counter(map(tuple, got.collect())) == plain_draw(docs, [])


def test_features_of_long_texts_by_slices(monkeypatch):
    text = "Ab c-d É1 " * 500
    whole = [np.concatenate([f for f, _ in resample.features(text)])]
    monkeypatch.setattr(resample, "word_slices", lambda data, overlap: common.word_slices(data, overlap, 13))
    cut = list(resample.features(text))
    assert len(cut) > 100 and sum(n for _, n in cut) == 2000
    assert sorted(np.concatenate([f for f, _ in cut])) == sorted(whole[0])


@pytest.mark.parametrize("pivots", [1, 4, 16])
def test_quickselect_finds_every_place(spark, pivots):
    rng = random.Random(9)
    rows = [(rng.randrange(12), rng.randrange(3)) for _ in range(80)]
    df = spark.createDataFrame(rows, "a long, b int").repartition(4)
    ordered = sorted(rows)
    for k in (1, 2, 40, 79, 80):
        place = resample.quickselect(df, ["a", "b"], k, pivots=pivots)
        assert place.key == ordered[k - 1]
        assert place.before == sum(r < place.key for r in rows) and place.equal == rows.count(place.key)
