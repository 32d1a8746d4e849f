"""Votes of repeated model calls over pairs (A9, A10), and the inputs of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST, BONUS, PENALTY = 60, 85, 3, 10


def self_consistency(votes: DataFrame, threshold: int = 2) -> DataFrame:
    """Votes (pair_id, run, is_contradiction, result) to the verdict of each pair, how stable it is, and the first run that agrees."""
    yes, n = F.count_if("is_contradiction"), F.count("*")
    most = F.greatest(yes, n - yes)
    df = votes.groupBy("pair_id").agg(
        (yes >= threshold).alias("is_contradiction"), F.bround(most / n, 2).alias("stability"), F.concat_ws("/", most.cast("string"), n.cast("string")).alias("agreement"),
        F.min_by("result", F.when(F.col("is_contradiction"), F.col("run"))).alias("first_yes"), F.min_by("result", F.when(~F.col("is_contradiction"), F.col("run"))).alias("first_no"),
    )
    best = F.coalesce(F.when(F.col("is_contradiction"), F.col("first_yes")).otherwise(F.col("first_no")), F.lit("NO CONTRADICTION FOUND"))
    return df.select("pair_id", "is_contradiction", "stability", "agreement", best.alias("best_result"))


def verify(records: DataFrame, votes: DataFrame) -> DataFrame:
    """A10: records (ord, confidence, llm_verified, a, b, ...) after two votes (key_a, key_b, yes, no) on their first 200 characters.

    Only records within the uncertain band that aren't verified yet and quote both statements take part; two yes raise the
    confidence, one lowers it, none drops the record; without votes it stays as it is.
    """
    asked = (F.col("confidence").between(LOWEST, HIGHEST)) & ~F.coalesce("llm_verified", F.lit(False)) & (F.coalesce("a", F.lit("")) != "") & (F.coalesce("b", F.lit("")) != "")
    keyed = records.withColumn("key_a", F.when(asked, F.substring("a", 1, 200))).withColumn("key_b", F.when(asked, F.substring("b", 1, 200)))
    counted = votes.groupBy("key_a", "key_b").agg(F.max("yes").alias("yes"), F.max("no").alias("no"))
    df = keyed.join(counted, ["key_a", "key_b"], "left")
    judged = F.coalesce(F.col("yes") + F.col("no") > 0, F.lit(False))
    df = df.where(~judged | (F.col("yes") > 0))
    new = F.when(judged & (F.col("yes") >= 2), F.least(F.lit(99), F.col("confidence") + BONUS)).when(judged, F.greatest(F.lit(60), F.col("confidence") - PENALTY)).otherwise(F.col("confidence"))
    verified = F.when(judged, F.col("yes") >= 2).otherwise(F.col("llm_verified"))
    return df.withColumn("confidence", new).withColumn("llm_verified", verified).drop("key_a", "key_b", "yes", "no")


def answered(requests: DataFrame, responses: DataFrame, key: str = "request_key", default: str = "NO CONTRADICTION FOUND") -> DataFrame:
    """Model calls as a join with a table of responses (key, response). Equal requests are asked once; a missing answer is the default."""
    unique = responses.groupBy(key).agg(F.max("response").alias("response"))
    return requests.join(unique, key, "left").withColumn("response", F.coalesce("response", F.lit(default)))


def surrogate_logits(pairs: DataFrame) -> DataFrame:
    """Logits from the gates' signals, a stand-in for a trained scorer and no match for one. ``pairs`` have ``signals`` and ``shared``."""
    n = F.size("signals").cast("double")
    return pairs.withColumn("logit_c", 1.5 * n).withColumn("logit_e", F.lit(0.0)).withColumn("logit_n", 1.0 - 0.25 * F.least(F.col("shared"), F.lit(4)))


def hashed_embedding(texts: DataFrame, text: str = "text", dim: int = 64) -> DataFrame:
    """A stand-in embedder: signed word hashes, summed and scaled to length one. Adds ``embedding``."""
    from ..functions.text import bm25_tokens

    words = bm25_tokens(F.col(text))
    slot = lambda i: F.aggregate(words, F.lit(0.0), lambda t, w: t + F.when(F.pmod(F.xxhash64(w), F.lit(dim)) == i, F.when(F.pmod(F.shiftright(F.xxhash64(w), 33), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), slot)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda t, v: t + v * v))
    return texts.withColumn("embedding", F.transform(raw, lambda v: v / F.greatest(norm, F.lit(1e-12))))
