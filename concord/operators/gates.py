"""Roles of statements and gates over pairs of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx

# Fixed values (patterns of the roles, in the order in which they are tried):
CAPTION = r"(?i)^\s*(?:figure|fig\.?|table|tbl\.?|exhibit|chart|appendix)\s*\d+"
CONTENTS_ROW = r"\.{3,}\s*\d+\s*$"
BOILERPLATE = r"(?i)\b(?:all\s+rights\s+reserved|subscriber\s+licen[cs]e|attribution\s+terms|data-use\s+and\s+redistribution|atlas\s+intelligence\s+prepares)\b"
METADATA = r"(?i)\b(?:survey\s+of|enterprise\s+respondents|primary\s+survey|sample\s+of|fielded\s+in|data\s+streams?|methodology|financial\s+disclosures|procurement\s+data|source(?:s|d|:)|reconciled\s+dataset|normalized\s+to|this\s+report\s+draws|rounding\s+conventions?|confidence\s+interval)\b"
DEFINITION = r"(?i)\b(?:is\s+defined\s+as|refers?\s+to|means\s+the|we\s+define|for\s+the\s+purposes?\s+of\s+this\s+(?:report|section)|in\s+this\s+report,?\s+[a-z]+\s+means)\b"
RECOMMENDATION = r"(?i)^\s*(?:-|•|\*|●|\(cid:127\))?\s*(?:we\s+recommend|recommendation|recommend|adopt|negotiate|invest|plan|consider|avoid|do\s+not|always|never|ensure|implement|establish|prioritise|prioritize|should|must)\b"
OBLIGATION = r"(?i)\b(?:must(?:\s+not)?|shall(?:\s+not)?|required\s+to|not\s+required\s+to|(?:not\s+)?permitted|(?:not\s+)?allowed\s+to|prohibited|forbidden|do\s+not\s+need\s+to|do\s+not\s+have\s+to|may\s+not|cannot|can't)\b"
HEDGE = r"(?i)\b(?:moved\s+decisively|tells?\s+a\s+story|paints?\s+a\s+picture|has\s+been\s+characterised|reflects?\s+a\s+broader|represents?\s+a\s+shift|marks?\s+a\s+turning\s+point|the\s+report\s+(?:that\s+follows|argues|quantifies)|this\s+edition|in\s+summary|broadly\s+speaking|one\s+view|in\s+our\s+view)\b"
PERCENT = r"\b\d+(?:\.\d+)?\s?%"
CURRENCY = r"\$\s?\d[\d,]*(?:\.\d+)?\s?(?:billion|million|trillion|B|M|T|k|K)?\b"
GROWTH = r"(?i)\bC?AGR\b|compound annual growth|year-over-year|YoY"
NUMBER = r"(?:\$\s?)?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|(?:\$\s?)?-?\d+(?:\.\d+)?"
NUMBER_OR_PERCENT = r"(?:\$\s?)?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?(?:\s?%)?|(?:\$\s?)?-?\d+(?:\.\d+)?(?:\s?%)?"
MONTH = r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\b"
DATE_CUE = r"(?i)\b(?:effective|starts?|starting|begin|begins|take\s+effect|takes\s+effect|valid|expires?|expiry|deadline|due|active\s+from|commences?)\b"
# Fixed values (words of the contradiction types):
TEMPORAL = ["before", "after", "daily", "weekly", "monthly", "quarterly", "immediately", "next quarter", "days", "hours"]
SCOPE = ["all", "every", "never", "always", "no ", "any ", "only"]
EXCEPTION = ["unless", "except", "if ", "may ", "however"]


def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def to_number(token: Column) -> Column:
    return F.trim(F.regexp_replace(token, r"[$%,]", "")).try_cast("double")


def numeric_backbone(s: Column) -> Column:
    """A percentage, a currency amount, a growth cue, two numbers, or one of 100 or more that is no bare year."""
    numbers = extract(s, NUMBER)
    large = F.exists(numbers, lambda t: (F.abs(to_number(t)) >= 100) & ~F.trim(t).rlike(r"^(?:19|20)\d{2}$"))
    return s.rlike(PERCENT) | s.rlike(CURRENCY) | s.rlike(GROWTH) | (F.size(numbers) >= 2) | F.coalesce(large, F.lit(False))


def role(text: Column) -> Column:
    """(role, score, reasons); the first rule that matches decides."""
    s, backbone = tx.strip(text), numeric_backbone(tx.strip(text))
    tag = lambda name, score, *reasons: F.struct(F.lit(name).alias("role"), F.lit(score).alias("score"), F.lit(list(reasons)).alias("reasons"))
    rules = [
        (s == "", tag("boilerplate", 1.0, "empty")), (s.rlike(CAPTION), tag("caption", 0.98, "caption_prefix")), (s.rlike(CONTENTS_ROW), tag("caption", 0.92, "toc_dotleader")), (s.rlike(BOILERPLATE), tag("boilerplate", 0.9, "boilerplate_cue")),
        (s.rlike(METADATA), tag("metadata", 0.85, "metadata_cue")), (s.rlike(DEFINITION), tag("definition", 0.9, "definition_cue")), (s.rlike(RECOMMENDATION), tag("recommendation", 0.85, "imperative_start")), (s.rlike(OBLIGATION), tag("claim", 0.8, "modal_obligation")),
        (s.rlike(HEDGE) & ~backbone, tag("narrative", 0.85, "narrative_hedge")), (s.rlike(HEDGE), tag("claim", 0.75, "narrative_hedge", "numeric_backbone")), (backbone, tag("claim", 0.75, "numeric_backbone")),
    ]
    ladder = F.when(*rules[0])
    for condition, value in rules[1:]:
        ladder = ladder.when(condition, value)
    return ladder.otherwise(tag("narrative", 0.55, "no_numeric_no_imperative"))


def compatible(a: Column, b: Column) -> Column:
    """Claims with claims, definitions with definitions."""
    return (a == b) & a.isin("claim", "definition")


def topical_overlap(a: Column, b: Column) -> Column:
    """P5: number of shared keywords."""
    return F.size(F.array_intersect(tx.keywords(a), tx.keywords(b)))


def shared_concepts(a: Column, b: Column) -> Column:
    """P15."""
    return F.size(F.array_intersect(tx.concept_tokens(a), tx.concept_tokens(b)))


#: All words of the antonym pairs that can be tokens or not; others of a statement don't matter there.
ANTONYM_WORDS = sorted({w for pair in lx.ANTONYMS for w in pair})


def _content(tokens: Column) -> Column:
    return F.filter(F.array_except(tokens, F.lit(lx.NEGATIONS + lx.FUNCTION_WORDS)), lambda w: F.length(w) > 2)


def _numbers(text: Column) -> Column:
    return F.filter(F.transform(extract(text, NUMBER_OR_PERCENT), to_number), lambda v: v.isNotNull() & (v != 0))


def _months(text: Column) -> Column:
    return F.array_distinct(F.transform(extract(text, MONTH), lambda m: F.lower(F.substring(m, 1, 3))))


def _first_pair(pairs: list[tuple[str, str]], in_a, in_b) -> Column:
    """The first pair that the sides hold between them, as (side a's word, side b's); null if none."""
    ladder = None
    for x, y in pairs:
        for p, q in ((x, y), (y, x)):
            condition, value = in_a(p) & in_b(q), F.array(F.lit(p), F.lit(q))
            ladder = F.when(condition, value) if ladder is None else ladder.when(condition, value)
    return ladder


def antonym_hit(ta: Column, tb: Column) -> Column:
    """P7."""
    return _first_pair(lx.ANTONYMS, lambda w: F.array_contains(ta, w), lambda w: F.array_contains(tb, w))


def modal_flip(a: Column, b: Column) -> Column:
    """By substring, so a longer form also counts as the shorter one it holds."""
    la, lb = F.lower(a), F.lower(b)
    return _first_pair(lx.MODALS, lambda w: la.contains(w), lambda w: lb.contains(w))


def numeric_delta(a: Column, b: Column, tolerance: float = 0.03, most_ratio: float = 10.0) -> Column:
    """(a, b, gap) of the pair of numbers with the largest gap within the same order of magnitude; the first of equals."""
    return _delta(_numbers(a), _numbers(b), tolerance, most_ratio)


def _delta(na: Column, nb: Column, tolerance: float = 0.03, most_ratio: float = 10.0) -> Column:
    gap = lambda x, y: F.abs(x - y) / F.greatest(F.abs(x), F.abs(y))
    near = lambda x, y: F.greatest(F.abs(x), F.abs(y)) / F.greatest(F.lit(1e-9), F.least(F.abs(x), F.abs(y))) <= most_ratio
    cross = F.flatten(F.transform(na, lambda x, i: F.transform(nb, lambda y, j: F.struct(gap(x, y).alias("gap"), (-i).alias("i"), (-j).alias("j"), x.alias("a"), y.alias("b"), near(x, y).alias("near")))))
    return F.array_max(F.filter(cross, lambda c: c["near"] & (c["gap"] > tolerance)))


def date_conflict(a: Column, b: Column) -> Column:
    """P10: months that differ where both sides speak of validity; of several months the first by alphabet is given."""
    side = lambda s: F.struct(_months(s).alias("months"), s.rlike(DATE_CUE).alias("cue"))
    return _conflict(side(a), side(b))


def _conflict(fa: Column, fb: Column) -> Column:
    ma, mb = fa["months"], fb["months"]
    differ = (F.size(ma) > 0) & (F.size(mb) > 0) & (F.array_sort(ma) != F.array_sort(mb))
    pick = lambda x, y: F.coalesce(F.array_min(F.array_except(x, y)), F.array_min(x))
    return F.when(differ & fa["cue"] & fb["cue"], F.array(pick(ma, mb), pick(mb, ma)))


def features(text: Column) -> Column:
    """What the gates need of one statement; computed once for each statement, not once for each pair."""
    tokens = tx.polarity_tokens(text)
    return F.struct(
        F.array_intersect(tokens, F.lit(ANTONYM_WORDS)).alias("antonyms"), F.arrays_overlap(tokens, F.lit(lx.NEGATIONS)).alias("negated"), _content(tokens).alias("content"), _numbers(text).alias("numbers"), _months(text).alias("months"), text.rlike(DATE_CUE).alias("cue"),
        F.lower(text).alias("low"), F.array_distinct(tx.keywords(text)).alias("keywords"), F.array_distinct(tx.concept_tokens(text)).alias("concepts"),
    )


def with_gate(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with the signals of columns a and b and whether any is there; columns fa and fb (``features``) are used if given."""
    given = "fa" in pairs.columns
    df = pairs if given else pairs.withColumn("fa", features(F.col(a))).withColumn("fb", features(F.col(b)))
    fa, fb = F.col("fa"), F.col("fb")
    df = df.withColumn("neg_a", fa["negated"]).withColumn("neg_b", fb["negated"]).withColumn("shared", F.size(F.array_intersect(fa["content"], fb["content"])))
    df = df.withColumn("antonym", F.when((F.size(fa["antonyms"]) > 0) & (F.size(fb["antonyms"]) > 0), antonym_hit(fa["antonyms"], fb["antonyms"]))).withColumn("modal", modal_flip(fa["low"], fb["low"])).withColumn("numeric", _delta(fa["numbers"], fb["numbers"])).withColumn("date", _conflict(fa, fb))
    df = df if given else df.drop("fa", "fb")
    one_sided = (F.col("neg_a") != F.col("neg_b")) & (F.col("shared") >= 2)
    df = df.withColumn("neg_side", F.when(one_sided, F.when(F.col("neg_a"), "a").otherwise("b"))).withColumn("numeric", F.when(F.col("shared") >= 1, F.col("numeric")))
    names = (("neg_side", "one_sided_negation"), ("antonym", "antonym_pair"), ("modal", "modal_flip"), ("numeric", "numeric_delta"), ("date", "date_conflict"))
    df = df.withColumn("signals", F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in names))))
    return df.withColumn("passed", F.size("signals") > 0).drop("neg_a", "neg_b", "shared")


def _has(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def contradiction_type(a: Column, b: Column) -> Column:
    """P16."""
    la, lb = F.lower(a), F.lower(b)
    both = F.concat_ws(" ", la, lb)
    digits = lambda s: F.array_sort(F.array_distinct(extract(s, r"\d+")))
    numerical = both.rlike(r"\d+[%$]?\s") & (F.size(digits(la)) > 0) & (F.size(digits(lb)) > 0) & (digits(la) != digits(lb))
    scope = _has(la, SCOPE) & _has(lb, SCOPE) & (la.contains("not ") | lb.contains("not ") | both.contains("prohibited") | both.contains("never"))
    conditional = both.contains("when ") | both.contains("provided ")
    return F.when(numerical, "Numerical").when(_has(both, TEMPORAL), "Temporal").when(scope, "Scope").when(_has(both, EXCEPTION), "Exception-based").when(conditional, "Conditional").otherwise("Direct")


def severity(confidence: Column) -> Column:
    """P17, of a confidence in per cent."""
    return F.when(confidence >= 85, "High").when(confidence >= 70, "Medium").otherwise("Low")


def gap_severity(gap: Column) -> Column:
    """P17, of a relative gap: (severity, confidence)."""
    level = lambda s, c: F.struct(F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    return F.when(gap >= 0.20, level("High", 97)).when(gap >= 0.05, level("Medium", 88)).otherwise(level("Low", 75))


def relative_gap(a: Column, b: Column) -> Column:
    """P18."""
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))
