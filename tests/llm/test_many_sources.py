"""Packing with more sources than one schedule serves: none is merged, renamed or left without its target."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60_000), min_size=1, max_size=40), st.integers(0, 2**31))
def test_all_queues_at_once_as_one_by_one(totals, seed):
    shares = np.random.default_rng(seed).random(len(totals)).tolist()
    for p in packing.phases(totals, shares):
        if p.takes is None:
            for u in (0, 1, p.windows):
                assert p.served_by_all(u).tolist() == [p.served(k, u) for k in range(len(totals))]


def test_levels_place_every_token_once():
    rng = np.random.default_rng(3)
    totals = [int(x) for x in rng.integers(0, 5000, 3 * packing.FAN + 5)]
    totals[7], totals[200] = 400_000, 1
    schedules = packing.levels(totals, [float(n) for n in totals])
    assert len(schedules) == 2 and len(schedules[0]) == 4
    placed = np.zeros(sum(totals), int)
    for k, total in enumerate(totals):
        if not total:
            continue
        start = np.arange(0, total, 700)
        row, from_, length, window, offset = packing.placed_pieces(schedules, k, start, np.minimum(total - start, 700))
        assert ((offset + length) <= packing.WINDOW).all() and length.sum() == total
        own = np.zeros(total, int)
        for r, f, n, w, o in zip(row, from_, length, window, offset):
            own[start[r] + f : start[r] + f + n] += 1
            placed[w * packing.WINDOW + o : w * packing.WINDOW + o + n] += 1
        assert (own == 1).all()
    assert (placed == 1).all()


def test_more_sources_than_a_schedule_serves(spark):
    rows = [(i, f"some words of document {i} " * (600 if i == 1099 else 40), f"s{i:05}") for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3, "doc_id")
    found = packing.pack(docs, WORDS, {"s01099": 0.9}).collect()
    assert {r.source for r in found} == {s for _, _, s in rows}
    assert all(r.source == f"s{r.doc_id:05}" for r in found)
    per_doc, filled = {}, {}
    for r in found:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.length
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert all(per_doc[r.doc_id] == r.doc_tokens for r in found)
    assert all(n == packing.WINDOW for w, n in filled.items() if w < max(filled))
    first = sum(r.length for r in found if r.source == "s01099" and r.sequence_id == 0)
    assert first >= 0.85 * packing.WINDOW
