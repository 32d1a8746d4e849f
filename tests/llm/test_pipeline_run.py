"""A whole run of the pipeline on the smallest tables, against plain Python where its models allow it."""

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from concord.llm import queries, similar

SF = "/root/testdata/sf0.001"


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_rules = {r.doc_id for r in queries.op8_quality_rules(spark, SF).collect() if r.kept}
    ids = sorted({p.doc_id for p in pieces})
    assert ids and set(ids) <= by_rules and len(ids) == len({texts[d] for d in ids})
    # No survivor is near another; all pairs are compared.
    prints = np.array([np.frombuffer(similar.fingerprint(texts[d]), np.uint64) for d in ids])
    near = sum(int((np.bitwise_count(prints[:i] ^ prints[i]).sum(1) <= similar.RADIUS).sum()) for i in range(len(ids)))
    assert near <= 1
    # Every id of a survivor lies in one piece, and sequences are gapless.
    documents, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        documents[p.doc_id].append((p.start, p.length, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in [sorted(x) for x in (*documents.values(), *sequences.values())]:
        at = 0
        for start, length, *_ in own:
            assert start == at
            at += length
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokenizer.no_truncation()
    for d, own in documents.items():
        assert sum(n for _, n, _ in own) == own[0][2]
        if not re.search(r"[0-9@]", texts[d]):  # nothing to redact
            assert own[0][2] == len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1
