"""Every operator against a plain version of the same rule, a library, or held-out labels."""

import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import xxhash
from concord.llm import ann, bpe, chat, components, gbt, licenses, packing, pii, queries, quality_rules, simhash, toxicity, wordbpe

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["it's 'tis don''t a'sun 12'3", "ÀÉ Ñ İ Σ ΑΣ", "a<|endoftext|> b", "   ", "x" * 3000, "ab" * 700, "é   \x85 1½²", "日本語 テスト \U0001f600\U0001f600"]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_word_vocabulary_allows_merging_by_bytes():
    """Every entry is what the merges make of its bytes; then merging by concatenation and by pairs agree (see packing)."""
    words = wordbpe.load(WORDS)
    assert list(words.ranks.values()) == list(range(len(words.ranks)))  # ids are in the order of the merges
    assert {k for k, v in words.ranks.items() if 256 <= v < 512} == {bytes([b]) + b" " for b in range(256)}
    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["merges"])}
    for token in spec["vocab"]:
        body, last = (token[:-4], "</w>") if token.endswith("</w>") else (token, "")
        parts = [*body[:-1], body[-1] + last]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 10**9))
            assert (parts[best], parts[best + 1]) in rank, token
            parts[best : best + 2] = [parts[best] + parts[best + 1]]


def test_word_ids(texts):
    words, known = wordbpe.load(WORDS), library(WORDS)
    for t in [*list(texts.values())[:60], *ODD]:
        assert words.ids(t).tolist() == known.encode(t, add_special_tokens=False).ids


def test_packing(spark, texts):
    known = library(WORDS)
    rows = queries.op1_packing(spark, SF).collect()
    ids = {d: [*known.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    at = {d: 0 for d in ids}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert all(at[d] == len(ids[d]) for d in ids)
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append(r)
    total, sources = sum(map(len, ids.values())), {r.source for r in rows}
    tokens = {s: sum(r.length for r in rows if r.source == s) for s in sources}
    for k, own in filled.items():
        assert sum(r.length for r in own) == packing.WINDOW or k == max(filled)
        if k < 0.9 * max(filled):  # each window holds each source's share, within rounding
            for s in sources:
                assert abs(sum(r.length for r in own if r.source == s) - packing.WINDOW * tokens[s] / total) < 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30_000), min_size=1, max_size=6), st.data())
def test_schedule_serves_every_token_once(totals, data):
    shares = data.draw(st.lists(st.floats(0, 1), min_size=len(totals), max_size=len(totals)))
    schedule, served = packing.phases(totals, shares), [0] * len(totals)
    window = {}
    for k, total in enumerate(totals):
        if total:
            _, start, length, w, offset = packing.pieces_of(schedule, k, np.array([0]), np.array([total]))
            served[k] = int(length.sum())
            for a, n, i in zip(offset.tolist(), length.tolist(), w.tolist()):
                window.setdefault(i, []).append((a, n))
    assert served == totals
    for i, own in window.items():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at == packing.WINDOW or i == max(window)
    assert len(schedule) <= 3 * len(totals) + 2


def test_small_queues_keep_their_place_in_every_window():
    """Many queues of less than a token per window: windows stay gapless, and in each phase every queue keeps near its exact share."""
    rng = random.Random(6)
    totals = [3_000_000, *(rng.randrange(1, 1500) for _ in range(300))]
    schedule, windows = packing.phases(totals, [float(n) for n in totals]), {}
    for p in schedule:
        if p.bounds:
            for u in range(0, p.windows + 1, max(1, p.windows // 7)):
                weights = np.diff(p.bounds)
                assert all(abs(p.served(k, u) - packing.WINDOW * u * int(w) / p.bounds[-1]) < p.depth + 1 for k, w in enumerate(weights))
    for k, total in enumerate(totals):
        step = np.arange(0, total, 700)
        row, _, length, w, offset = packing.pieces_of(schedule, k, step, np.minimum(total - step, 700))
        assert np.bincount(row, length).tolist() == np.minimum(total - step, 700).tolist()
        for a, n, i in zip(offset.tolist(), length.tolist(), w.tolist()):
            windows.setdefault(i, []).append((a, n))
    for i, own in windows.items():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        assert sum(n for _, n in own) == packing.WINDOW or i == max(windows)


def test_packing_targets(spark):
    df = spark.createDataFrame([(i, "word " * 3000, "ab"[i % 2]) for i in range(8)], "doc_id long, text string, source string")
    rows = packing.pack(df, WORDS, {"a": 0.75, "b": 0.25}).collect()
    first = {s: sum(r.length for r in rows if r.sequence_id == 0 and r.source == s) for s in "ab"}
    assert first == {"a": 1536, "b": 512}


def test_bpe(texts):
    own, known = bpe.Bpe(BYTES), library(BYTES)
    sample = [*list(texts.values())[:60], *ODD]
    for t, ids in zip(sample, own.encode(sample)):
        e = known.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == e and own.decode(ids) == known.decode(e, skip_special_tokens=False)
    rng = random.Random(3)
    for n in (2, 3, 17, 200, 1500):
        piece = bytes(rng.choice(b"abcde the") for _ in range(n))
        size = 1 << max(1, (n - 1).bit_length())
        assert own.merge_one(piece).tobytes() == own.merge_many([piece], size)[0]


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(values, radius=2):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def test_simhash(spark, texts):
    got = {r.doc_id: r for r in queries.op9_simhash(spark, SF).collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    roots = components_of(sorted(set(prints.values())))
    for d in texts:
        assert got[d].fingerprint == f"{prints[d]:016x}"
        assert got[d].component_id == min(e for e in texts if roots[prints[e]] == roots[prints[d]])


@pytest.mark.parametrize("shard", [20_000, 3])
def test_links_of_close_fingerprints(spark, monkeypatch, shard):
    """Chains and clusters of fingerprints, with shards so small that hot ones are split, lose no link."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(100)}
    for v in list(values)[:40]:
        for _ in range(8):
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(v)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.node: r.root for r in components.connected_components(simhash.links(df)).collect()}
    roots = components_of(sorted(values))
    groups = {}
    for v in values:
        groups.setdefault(roots[v], set()).add(v)
    for own in groups.values():
        low = min(map(signed, own))
        assert {found.get(signed(v), signed(v)) for v in own} == {low}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**12 - 1), max_size=120), st.integers(0, 2**12 - 1), st.integers(0, 4))
def test_bk_tree(values, asked, radius):
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    assert {tree.values[i] for i in tree.within(asked, radius)} == {v for v in values if (v ^ asked).bit_count() <= radius}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = lambda: sum((int(x) * 2 - 9 * (int(x) > 4)) if i % 2 else int(x) for i, x in enumerate(reversed(digits))) % 10 == 0
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(), "phone": lambda: 10 <= len(digits) <= 15}[kind]()

    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if valid(k, m[0])]
    return [x for *_, x in sorted(found)]


def test_pii(spark, texts):
    rng = random.Random(9)
    alphabet = ["a", "b@", "c.d", "@e.f", ".", "_", "1", "22", "255.", "256.", " ", "-", "+1", "(2) ", "4111 1111 1111 1111", "é", "\n", "+1 (212) 555-0100", "x@y.z", "😀"]
    odd = {-i: "".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for i in range(1, 400)}
    df = spark.createDataFrame([(d, t) for d, t in [*texts.items(), *odd.items()]], "doc_id long, text string")
    for r in pii.find(df).collect():
        own = plain_spans({**texts, **odd}[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest(), {**texts, **odd}[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in own) for k in PLAIN]
        assert set(own) <= set(r.spans.split(",")) | {""}


def test_pii_adds_spans_and_redacts(spark):
    cases = [("please call (212) 555-0187 today", "please call [PHONE] today"), ("mail jo.doe [at] example [dot] org now", "mail [EMAIL] now"), ("invoice 212.555.018 of order", "invoice 212.555.018 of order"), ("x@y.zz and 10.0.0.1", "[EMAIL] and [IP]"), ("no data here", "no data here"), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == [c for _, c in cases]
    plan = pii.redact(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_is_linear(spark):
    hard = ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a.b" * 60_000 + "@", "(1) " * 50_000]
    assert pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id long, text string")).count() == len(hard)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n", "<|im_end|>", ""]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "INST]", "\n", "é", "😀", "s>", "|im_end|>"]), max_size=8).map("".join)), min_size=1, max_size=12))
def test_chat(turns):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(turns)), pa.array([r for r, _ in turns]), pa.array([t for _, t in turns])], names=["c", "r", "t"])
    out = list(chat._pieces([batch]))
    pieces = [(f, s) for b in out for f, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
    assert [x for f, _ in pieces for x in chat.parse(f)] == turns
    assert [chat.unescape(f[s["start"] : s["end"]]) for f, spans in pieces for s in spans] == [t for r, t in turns if r == "assistant"]
    row = next(chat._read_back(out)).to_pylist()[0]
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_query(spark):
    rows = {r.conv_id: r for r in queries.op2_chat(spark, SF).collect()}
    own = "</s>[INST] ok [/INST]"
    assert rows[-7].loss_sha256 == hashlib.sha256(own.encode()).hexdigest() and rows[-7].loss_chars == len(own)
    plain = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        plain.setdefault(r.conv_id, []).append(f"{r.role}\n{r.text}\n")
    assert {c: hashlib.sha256("".join(t).encode()).hexdigest() for c, t in plain.items()} == {c: r.turns_sha256 for c, r in rows.items() if c != -7}


def test_licenses(spark):
    texts = ["Released under the MIT License.", "a\nlicensed under the APACHE license version 2.0\nb", "Licensed under CC BY-NC 4.0", "x\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies.\n\ny", "no licence at all " * 30, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(df).collect())
    assert [r[1] for r in got] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0", "ISC-text", None, None, None]
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    assert sorted(c.sql(licenses.oracle_sql()).fetchall()) == got


def learned(spark, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    return [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_toxicity_on_held_out_labels(spark):
    rows = queries.op3_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = learned(spark, rows, "toxic")
    # some labels of this table are noise: documents without any toxic word are marked, and the reverse
    assert np.mean([p for _, p, y in held if y == 1]) > 0.85 and np.mean([p for _, p, y in held if y == 0]) < 0.02


def test_toxicity_learns_a_pair():
    """Neither term is toxic alone; both together are."""
    rng = random.Random(2)
    sets, y = [], []
    for _ in range(1200):
        s = [i for i in range(6) if rng.random() < 0.4]
        sets.append(s)
        y.append(float(0 in s and 1 in s))
    machine = toxicity.fit(sets, np.array(y), 6, epochs=200)
    score = lambda *s: toxicity.sigmoid(machine.margin(np.array(s, np.int64), np.array([len(s)])))[0]
    assert score(0, 1) > max(score(0), score(1), score(0, 2), score(1, 3)) + 0.3


def test_quality_on_held_out_labels(spark):
    held = learned(spark, queries.op5_quality(spark, "/root/testdata/sf0.1").collect(), "quality")
    assert np.mean([p == y for _, p, y in held]) > 0.98


def test_flattened_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = gbt.fit(x, y)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.97

    def walk(row, node):
        while trees.feature[node] >= 0:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    assert np.allclose(trees.margin(x[:50]), [trees.bias + sum(walk(r, n) for n in trees.roots) for r in x[:50]])


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {w: windows.count(w) for w in set(windows)} if len(windows) < 3000 else __import__("collections").Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality_rules(spark, texts):
    rows = queries.op8_quality_rules(spark, SF).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    for text in ["a b c a b c", "a a a a", "x\n\nx\n \nx", "| | \x1f ½", "a b c d a b c"]:
        assert quality_rules.judge([text], np.zeros(quality_rules.BUCKETS))[0][:5] == plain_counts(text)


def test_quality_rules_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in queries.op8_quality_rules(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for k, q in judged if q == 1]) > 0.99 and np.mean([k for k, q in judged if q == 0]) < 0.1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_nearest_neighbours(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, e = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in ann.search(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")).collect():
        assert abs(r.score - e[ids == r.query_id][0] @ e[ids == r.vec_id][0]) < 1e-12
        got.setdefault(r.query_id, {})[r.vec_id] = r["rank"]
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = e @ e[ids == q][0]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        assert sorted(got[q].values()) == list(range(1, 21))
        hits, total = hits + len(set(best.tolist()) & got[q].keys()), total + 20
    assert hits / total >= 0.9
