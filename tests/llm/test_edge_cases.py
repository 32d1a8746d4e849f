"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names: every operator and stage."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concord.llm import ann, bpe, chat, common, licenses, packing, pii, quality_model, quality_rules, simhash, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = "alpha beta gamma delta. " * 20_000
PROSE = " ".join(f"word{i} goes on" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, pii_text string, q_id long, score string, ids string, sh_a long, kept string, license string, terms string, e string"
CLASH = (1, "x", 2, "y", "z", 3, "w", "v", "u", "t")


def documents(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (5, LONG), (None, PROSE), (None, None), (6, "<|endoftext|> a\x01b\x02 é\U0001f600 " + "x" * 5000), (7, PROSE + " end")]
    return spark.createDataFrame([(i, t, None, None if n % 2 else "s", None, *CLASH) for n, (i, t) in enumerate(rows)], SCHEMA)


def labels(spark, rows=((4, 1, 1), (5, 0, 0), (None, 1, 1), (2, None, None), (7, 7, 7))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def empty(df):
    return df.where("false")


def test_packing(spark):
    docs = documents(spark)
    rows = packing.pack(docs, WORDS).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1  # a null text is the end token
    by_window = {}
    for r in rows:
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_window.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(empty(docs), WORDS).count() == 0


@pytest.mark.parametrize("stage", ["quality", "toxicity"])
def test_classifiers(spark, stage):
    module = {"quality": quality_model, "toxicity": toxicity}[stage]
    docs = documents(spark)
    for own in (labels(spark), empty(labels(spark))):
        rows = module.score(docs, module.train(docs, own)).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD) and r.held_out is not None for r in rows)
    assert module.score(empty(docs), module.train(empty(docs), labels(spark))).count() == 0


def test_quality_rules(spark):
    docs = documents(spark)
    for own in (labels(spark), empty(labels(spark))):
        weight = quality_rules.weights(quality_rules.counted(docs, own))
        rows = quality_rules.rules(docs, weight).collect()
        assert len(rows) == docs.count()
        assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
        assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3, 5))
        assert quality_rules.kept(docs, weight).columns == docs.columns
    assert quality_rules.rules(empty(docs), quality_rules.weights(quality_rules.counted(empty(docs), labels(spark)))).count() == 0


def test_simhash(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {(r.fp, r.component_id) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 1)}
    assert {r.component_id for r in rows if r.doc_id == 4} == {4}
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["1", "4"]
    assert simhash.near_duplicates(empty(docs)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({r.component_id for r in rows})


def test_simhash_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(df).collect()] == [None, None]
    assert simhash.one_of_each(df).count() == 1


def test_simhash_tells_nulls_apart(spark):
    df = spark.createDataFrame([(1, None, "a b c"), (1, "a b c", None)], "doc_id long, lang string, text string")
    assert simhash.one_of_each(df).count() == 2


def test_bpe(spark):
    docs = documents(spark)
    rows = bpe.round_trip_digests(docs, BYTES).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, none, none)}
    texts = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert {r.decoded_sha256 for r in rows} == texts
    back = bpe.decode(bpe.encode(docs, BYTES), BYTES)  # replaces the column ids that the table already has
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert bpe.round_trip_digests(empty(docs), BYTES).count() == 0
    odd = spark.createDataFrame([(None,), ([72, None, 10**8, -1],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, BYTES).collect()] == ["", bpe.load(BYTES).bytes_of[72].decode("utf-8", "replace")]


def test_pii(spark):
    docs = documents(spark)
    assert pii.find(docs).count() == docs.count()
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert out.select("text").exceptAll(docs.select("text")).count() == 0  # nothing personal in these
    assert pii.find(empty(docs)).count() == 0


def test_licenses(spark):
    docs = documents(spark)
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and {(r.license, r.dice, r.n_lines) for r in rows} == {(None, 0.0, 0)}
    assert licenses.scan(empty(docs)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, None, None, "b"), (None, 1, "assistant", "c" * 300_000), (2, 5, "assistant", "</s>[INST] <|im_end|>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    out = {r.conv_id: r for r in chat.digests(df).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 4 and out[1].turns_sha256 == digest("\nb\nuser\na\nuser\na\nassistant\n\n") and out[1].loss_chars == 0
    assert out[None].loss_chars == 300_000 and out[2].loss_sha256 == digest("</s>[INST] <|im_end|>")
    assert chat.digests(empty(df)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, cell string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert [x[2] for x in got if x[0] == 20] == [0, 0, 1, 2] and {x[3] for x in got if x[0] == 20} == {0.0}
    assert [x[1:3] for x in got if x[0] == 0] == [(1, 0), (2, 1), (3, 2), (4, 20)]  # the repeated row is one query, and its other copy a neighbour
    assert ann.search(empty(df)).count() == 0


def test_ann_repeated_ids(spark):
    """Candidates are all rows but the query's own, against plain ranking of rows; only distinct (id, vector) pairs ask."""
    rows = [(0, [1.0, 0.0])] * 25 + [(1, [1.0, 0.0])] * 3 + [(2, [0.5, 0.5])] * 2 + [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [2.0, 0.0])]
    found = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    wanted = {}
    for own in sorted(set((i, tuple(v)) for i, v in rows if i % 20 == 0)):
        others = [(i, tuple(v)) for i, v in rows]
        others.remove(own)
        ranked = sorted((-sum(a * b for a, b in zip(own[1], v)), i) for i, v in others)[:20]
        wanted.setdefault(own[0], []).extend((n + 1, i, -s) for n, (s, i) in enumerate(ranked))
    assert {q: sorted(x) for q, x in found.items()} == {q: sorted(x) for q, x in wanted.items()}


def test_shared_folder_is_never_local_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark).withColumn("text", F.regexp_replace("text", "alpha", "alpha +1 (212) 555-0100"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for own in (docs, empty(docs)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, own, str(tmp_path))
            assert out.columns == docs.columns, name
            out.count()
        corpus_pipeline.pack(spark, own, str(tmp_path)).count()
