"""Near-duplicates of a similarity of 0.8 over five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import components, similar, simhash

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(5000)]


def components_of(prints, radius):
    """Sets of rows, by comparing all pairs."""
    own = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= radius and own[i] != own[j]:
                own = [own[j] if x == own[i] else x for x in own]
    return {frozenset(i for i, x in enumerate(own) if x == r) for r in own}


def clustered(rng, n):
    """Fingerprints in chains and clusters, and some apart."""
    found = [rng.integers(0, 1 << 64, similar.LONGS, np.uint64) for _ in range(8)]
    while len(found) < n:
        one = found[rng.integers(len(found))].copy()
        for bit in rng.integers(0, 64 * similar.LONGS, rng.integers(1, 60)):
            one[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        found.append(one)
    return np.unique(np.array(found), axis=0)


@pytest.mark.parametrize("n", [9, 40, 150])
def test_components_within_a_shard(n):
    for seed in range(5):
        prints = clustered(np.random.default_rng(seed), n)
        wanted = components_of(prints, similar.RADIUS)
        roots = dict(similar.flood(prints, similar.RADIUS))
        assert not set(roots.values()) & set(roots)
        assert {frozenset(i for i in range(len(prints)) if roots.get(i, i) == r) for r in range(len(prints)) if r not in roots} == wanted
        whole = [int.from_bytes(p.tobytes(), "little") for p in prints]
        roots = dict(simhash.forest(whole, similar.RADIUS))
        assert {frozenset(i for i, v in enumerate(whole) if roots.get(v, v) == r) for r in whole if r not in roots} == wanted


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(WORDS)
    return words


def jaccard(a, b):
    a, b = (set(zip(*(x[i:] for i in range(5)))) for x in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(3)
    rows, copies, apart = [], [], []
    for i in range(300):
        own = rng.choices(WORDS, k=rng.randint(150, 300))
        rows.append((10 * i, " ".join(own)))
        near = changed(rng, own, rng.randint(1, 3))
        assert jaccard(own, near) >= 0.8
        copies.append((10 * i + 1, " ".join(near).upper()))
        far = own[: len(own) // 2] + rng.choices(WORDS, k=len(own) // 2)  # a passage in common
        assert jaccard(own, far) < 0.4
        apart.append((10 * i + 2, " ".join(far)))
    df = spark.createDataFrame(rows + copies + apart, "doc_id long, text string").withColumn("sh_text", F.lit(1))
    kept = {r.doc_id for r in similar.one_of_each(df).collect()}
    assert kept >= {d for d, _ in rows} | {d for d, _ in apart}
    assert len(kept & {d for d, _ in copies}) <= 3


@pytest.mark.parametrize("block", [20_000, 60])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    """Different near copies of one text, also where their shards are dealt into blocks, leave one document."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(4)
    own = rng.choices(WORDS, k=300)
    rows = [(7 + i, " ".join(changed(rng, own, 2))) for i in range(500)] + [(1000 + i, " ".join(rng.choices(WORDS, k=100))) for i in range(200)]
    kept = sorted(r.doc_id for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [7, *range(1000, 1200)]


def test_links_reach_real_near_copies(spark):
    """Against all pairs of the smallest table: documents of a similarity of 0.8 or more share a component, documents under 0.4 do not link."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sets = {d: set(similar.shingles(t).tolist()) for d, t in texts.items()}
    fp = {d: similar.fingerprint(t) for d, t in texts.items()}
    found = components.connected_components(similar.links(spark.createDataFrame([(bytearray(x),) for x in set(fp.values())], "fp binary"))).collect()
    root = {bytes(r.node): bytes(r.root) for r in found}
    ids, close, missed = sorted(texts), 0, 0
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                close += 1
                missed += root.get(fp[a], fp[a]) != root.get(fp[b], fp[b])
            elif both < 0.4 * len(sets[a] | sets[b]) and min(len(sets[a]), len(sets[b])) >= 50:
                x, y = (np.frombuffer(fp[d], np.uint64) for d in (a, b))
                assert np.bitwise_count(x ^ y).sum() > similar.RADIUS
    assert close and missed <= 0.1 * close


def test_odd_input(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (None, "one"), (6, "one two three four"), (6, "one two three four"), (7, "long " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("fp"), F.lit(2).alias("sh_text"), F.lit(3).alias("shard"))
    out = similar.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 6, 7]
    assert similar.one_of_each(df.limit(0)).count() == 0
    assert similar.one_of_each(df.where("doc_id is null")).count() == 1


def test_shards_in_blocks_lose_no_link(spark, monkeypatch):
    """Pairs in the company of many others, all in one shard of more than one block: each pair is linked, and nothing else is."""
    monkeypatch.setattr(similar, "BLOCK", 50)
    monkeypatch.setattr(similar, "tables", lambda n: [np.arange(8)])
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 64, (200, similar.LONGS), np.uint64) & ~np.uint64(255)
    near = prints.copy()
    near[:, 1] ^= np.uint64((1 << 30) - 1)
    crowd = np.repeat(rng.integers(0, 1 << 64, (1, similar.LONGS), np.uint64) & ~np.uint64(255), 120, axis=0)
    crowd[:, 2] ^= np.uint64(1) << np.arange(8, 128, dtype=np.uint64) % np.uint64(56)
    crowd[:, 3] ^= np.arange(120, dtype=np.uint64)
    rows = np.unique(np.concatenate((prints, near, crowd)), axis=0)
    wanted = components_of(rows, similar.RADIUS)
    assert sorted(map(len, wanted))[-2:] == [2, 120] and len(wanted) == 201
    found = components.connected_components(similar.links(spark.createDataFrame([(bytearray(p.tobytes()),) for p in rows], "fp binary"))).collect()
    root, place = {bytes(r.node): bytes(r.root) for r in found}, {p.tobytes(): i for i, p in enumerate(rows)}
    groups = {}
    for p, i in place.items():
        groups.setdefault(root.get(p, p), set()).add(i)
    assert set(map(frozenset, groups.values())) == wanted
