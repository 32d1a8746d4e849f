"""Personal data by candidate boosting, in DataFrame functions throughout.

Generators of high recall propose overlapping spans: the four base patterns (whose valid matches always stay) and looser ones
(spelled-out addresses, numbers in national formats, digit groups that only resemble cards). Every candidate gets features of
its format (digits, separators, groups, check digit, brackets) and of its context (cue words before and after,
neighbouring characters); boosted trees, unrolled to CASE expressions, give its probability, and a threshold for each
kind, calibrated to ``PRECISION`` on a held-out half of the training candidates, selects what is redacted.

The trees are fitted on the driver when the query is planned, from ``TRAIN_SPANS`` generated candidates (formats and
contexts drawn by a fixed seed from the lists below), so the model is the same everywhere. Offsets are code points.

Work is linear in a text's length, also where all of it is matches: patterns are possessive and begin only where a run of their
characters begins, places are running sums, what base spans cover is found by one running maximum over all spans in order, and
contexts and redacted texts are put together from blocks of the text.

A candidate that a base span covers is redacted with it; one that only overlaps a base span, or another candidate, is judged by the trees
like any other.

Numbers in other national formats (7 to 15 digits, bare or in up to six groups) are proposed as well and have trees of their own,
so that they take nothing from the other candidates.

Odd input: null and empty texts have no spans; control characters 1 and 2 in a text count as one other character each;
repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positions import cut, let, match_spans, running, text_blocks
from . import gbt
from .common import free_prefix

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns; linear forms with the same matches as the plain ones.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The looser generators.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*+\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?[a-z0-9-]++(?:\x20?(?:[\[({]\x20?(?:dot|\.)\x20?[\])}]|\.)\x20?[a-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[.\x20-])[0-9]{3,4}[.\x20-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
    # one to six groups, the first in brackets or not; of 7 to 15 digits in all
    "phone_any": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{1,5}+\)[\x20/-]?+[0-9]{1,15}+(?:[.\x20/-][0-9]{1,15}+){0,4}+|[0-9]{1,15}+(?:[.\x20/-][0-9]{1,15}+){0,5}+)(?![0-9A-Za-z]|[.-][0-9])",
}
BYTE_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CONTEXT = 40
CUES = {
    "phone": "phone|tel|smartphone|call|mobile|cell|fax|dial|reach|sms|whatsapp|text me",
    "email": "mail|e-?mail|contact|write|reach|address|send",
    "card": "card|visa|mastercard|amex|credit|debit|pay|cvv|expir",
    "other": "order|invoice|isbn|issn|version|serial|ref|item|article|sku|page|part no|build|lot|batch|date|score|doi|total|qty",
}
#: Cues begin where a word begins; the second form is Java's.
CUE, CUE_JAVA = r"(?<![^\W\d_])(?:{})", r"(?<!\p{{L}})(?:{})"
FEATURES = ("kind", "length", "digits", "separators", "groups", "longest_group", "luhn", "bracket", "dots", "cue_phone", "cue_email", "cue_card", "cue_other", "letter_before", "symbol_before", "digit_after", "leading_zero", "cue_foreign")
#: More cues for phones, for the model of ``phone_any``.
FOREIGN = "tél|appele|portable|numéro|rufnummer|handy|anruf|móvil|llam"
TRAIN_SPANS = 6000
PRECISION = 0.98
TREES, DEPTH = 24, 3


def _generated(rng: np.random.Generator, count: int) -> tuple[list[tuple], np.ndarray]:
    """(kind, before, span, after) and whether it is personal."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    words = ("the", "was", "and", "of", "seen", "in", "near", "une", "der", "las", "report", "thing", "line", "then")
    cue = {k: v.split("|") for k, v in CUES.items()}
    rows, truth = [], []
    for _ in range(count):
        kind = pick(("phone", "phone", "email", "card"))
        true = bool(rng.integers(2))
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            span = pick((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")) if true else pick((f"{digits(2)}-{digits(3)}-{digits(3)}", f"{a} {b} {c}", f"{digits(4)}-{digits(4)}-{digits(4)}", f"{a}.{b}.{digits(3)}", f"{a}-{b}-{c}"))
        elif kind == "email":
            name, host, top = pick(("jo.doe", "anna", "m_lee7", "support", "x")), pick(("mail", "example", "corp-site")), pick(("com", "org", "de"))
            span = pick((f"{name} [at] {host} [dot] {top}", f"{name}(at){host}.{top}", f"{name} (at) {host} (dot) {top}", f"{name}[@]{host}.{top}")) if true else pick((f"{pick(words)} (at) {pick(words)}.{digits(2)}", f"a[at]{digits(1)}.{digits(1)}", f"f(at)x.{digits(3)}"))
        else:
            stem = pick("3456") + digits(14)
            last = (10 - sum((d := int(x)) * 2 - 9 * (d > 4) if i % 2 == 0 else int(x) for i, x in enumerate(stem)) % 10) % 10
            span = f"{stem}{last}" if true else pick((f"{stem}{(last + 1 + rng.integers(9)) % 10}", digits(13), digits(20), digits(16)))
            span = pick((span, "-".join(re.findall(".{1,4}", span)), " ".join(re.findall(".{1,4}", span))))
        context = pick(cue[kind]) if rng.random() < (0.75 if true else 0.1) else pick(cue["other"]) if rng.random() < (0.03 if true else 0.75) else pick(words)
        rows.append((kind, f"{pick(words)} {context}{pick((': ', ' ', ' is ', '. '))}", span, pick((" ", ". ", ", ", "", " x"))))
        truth.append(true)
    return rows, np.array(truth, float)


def _generated_numbers(rng: np.random.Generator, count: int) -> tuple[list[tuple], np.ndarray]:
    """The same for candidates of ``phone_any``: national formats, and dates, amounts and identifiers."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    number = lambda least, most: f"{rng.integers(least, most + 1):02}"
    words = ("the", "was", "and", "of", "seen", "in", "near", "une", "der", "las", "report", "thing", "line", "then")
    cues, other = [*CUES["phone"].split("|"), *FOREIGN.split("|")], CUES["other"].split("|")
    rows, truth = [], []
    for _ in range(count):
        true = bool(rng.integers(2))
        a, b, pairs = digits(3), digits(3), [digits(2) for _ in range(4)]
        if true:
            north = (f"({a}) {b}-{digits(4)}", f"{a}-{b}-{digits(4)}", f"{a}.{b}.{digits(4)}", f"{a} {b} {digits(4)}")
            french = tuple(sep.join((f"0{pick('1234567')}", *pairs)) for sep in " .-")
            spanish = (f"{pick('679')}{digits(2)} {' '.join(pairs[:3])}", f"{pick('679')}{digits(2)} {a} {b}", f"{pick('679')}{digits(2)}-{a}-{b}")
            german = (f"0{digits(2)} {digits(8)}", f"(0{digits(2)}) {digits(7)}", f"0{digits(3)} {digits(7)}", f"0{digits(3)}-{digits(7)}", f"0{digits(2)}/{digits(7)}", f"0{digits(2)} {a} {b} {digits(2)}")
            bare = (f"0{digits(9)}", digits(10), f"{pick('679')}{digits(8)}", digits(7))
            span = pick(pick((north, french, spanish, german, bare)))
        else:
            day = (number(1, 28), number(1, 12), number(1950, 2049))
            dates = tuple(sep.join(x) for sep in ".-/" for x in (day, day[::-1]))
            numbers = (f"{number(1, 999)}.{a}.{b}", f"{number(1, 999)} {a} {b}", f"{day[2]}-{number(1950, 2049)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", " ".join(pairs), f"{digits(4)} {digits(4)}")
            span = pick(pick((dates, numbers, numbers, (digits(7 + rng.integers(9)),), (f"{a} {b} {digits(4)}", f"{a}-{b}-{digits(4)}"))))
        draw = rng.random()
        context = pick(cues) if draw < (0.9 if true else 0.005) else pick(words) if draw < (0.99 if true else 0.5) else pick(other)
        rows.append(("phone", f"{pick(words)} {context}{pick((': ', ' ', ' is ', '. '))}", span, pick((" ", ". ", ", ", "", " x"))))
        truth.append(true)
    return rows, np.array(truth, float)


def _features(kind: str, before: str, span: str, after: str) -> list[float]:
    """What ``feature_columns`` computes, for training."""
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    luhn = bool(digits) and sum((d := int(x)) * 2 - 9 * (d > 4) if i % 2 else int(x) for i, x in enumerate(reversed(digits))) % 10 == 0
    near = before[-CONTEXT:].lower()
    return [
        KINDS.index(kind), len(span), len(digits), len(re.findall(r"[\x20().-]", span)), len(groups), max(map(len, groups), default=0), luhn, bool(re.search(r"[(\[{]", span)), span.count("."),
        *(bool(re.search(CUE.format(CUES[c]), near)) for c in ("phone", "email", "card", "other")), bool(re.search("[A-Za-z]$", before)), bool(re.search("[#$=_/:-]$", before)), bool(re.match("[0-9]", after)), bool(re.match(r"\(?0", span)), bool(re.search(CUE.format(FOREIGN), near)),
    ]


@lru_cache(maxsize=2)
def model(numbers: bool = False) -> tuple[gbt.Trees, dict[str, float]]:
    """The trees and the threshold (of the margin) for each kind; ``numbers``: those of ``phone_any``, which are learned apart."""
    rows, truth = (_generated_numbers if numbers else _generated)(np.random.default_rng(11), TRAIN_SPANS)
    x = np.array([_features(*r) for r in rows], float)
    if not numbers:
        x = x[:, :-2]
    half = np.arange(len(rows)) % 2 == 0
    trees = gbt.fit(x[half], truth[half], trees=TREES, depth=DEPTH, rate=0.3, bins=32)
    margin, limits = trees.margin(x[~half]), {}
    for kind in KINDS:
        own = x[~half][:, 0] == KINDS.index(kind)
        order = np.argsort(-margin[own], kind="stable")
        right = np.cumsum(truth[~half][own][order])
        good = np.flatnonzero(right >= PRECISION * np.arange(1, len(order) + 1))
        limits[kind] = float(max(0.0, margin[own][order][good[-1]])) if len(good) else float("inf")
    return trees, limits


def tree_sql(trees: gbt.Trees, values: str) -> str:
    """The margin of flattened trees as one SQL expression of CASEs over the array ``values``."""

    def of(node: int) -> str:
        if trees.feature[node] < 0:
            return f"{float(trees.value[node])!r}D"
        return f"CASE WHEN {values}[{int(trees.feature[node])}] <= {float(trees.threshold[node])!r}D THEN {of(trees.left[node])} ELSE {of(trees.right[node])} END"

    return " + ".join([f"{trees.bias!r}D", *(of(int(root)) for root in trees.roots)])


def feature_columns(kind: Column, before: Column, span: Column, after: Column) -> list[Column]:
    number = lambda c: c.cast("double")
    digits = F.regexp_replace(span, "[^0-9]", "")
    groups = F.regexp_extract_all(span, F.lit("[0-9]+"), F.lit(0))
    near = F.lower(before)
    return [
        number(kind), number(F.length(span)), number(F.length(digits)), number(F.regexp_count(span, F.lit(r"[\x20().-]"))), number(F.size(groups)), number(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))), number((digits != "") & F.call_function("luhn_check", digits)), number(span.rlike(r"[(\[{]")), number(F.regexp_count(span, F.lit(r"\."))),
        *(number(near.rlike(CUE_JAVA.format(CUES[c]))) for c in ("phone", "email", "card", "other")), number(before.rlike("[A-Za-z]$")), number(before.rlike("[#$=_/:-]$")), number(after.rlike("^[0-9]")), number(span.rlike(r"^\(?0")), number(near.rlike(CUE_JAVA.format(FOREIGN))),
    ]


SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def matches(text: str, pattern: str, kind: str) -> Column:
    """All matches of a pattern in column ``text``, with their offsets."""
    span = lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), m["raw"].alias("text"))
    return F.when(F.col(text).rlike(pattern), F.transform(match_spans(F.col(text), pattern), span)).otherwise(F.array().cast(SPAN))


def _valid(kind: str, span: Column) -> Column:
    digits = F.regexp_replace(span, "[^0-9]", "")
    if kind == "ip":
        return span.rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _validator(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["text"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == KINDS.index(kind)


def with_spans(documents: DataFrame, text: str = "text", p: str = "pii_") -> DataFrame:
    """``documents`` with ``pii_base`` and ``pii_spans`` (or another prefix p): arrays of (start, kind, end, text), ordered; base spans are in
    both; and ``pii_blocks``, the text in blocks, where it has any candidate."""
    df = documents.withColumn(f"{p}text", F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\u0001\u0002", "\u0003\u0003"))
    for kind, pattern in BASE.items():
        df = df.withColumn(f"{p}{kind}", matches(f"{p}text", pattern, kind))
    for name, pattern in LOOSE.items():
        df = df.withColumn(f"{p}loose_{name}", matches(f"{p}text", pattern, name.split("_")[0]))
    n_digits = lambda s: F.length(F.regexp_replace(s["text"], "[^0-9]", ""))
    base = F.array_sort(F.concat(*(F.filter(f"{p}{k}", _validator(k)) for k in BASE)))
    resembling = F.filter(f"{p}card", lambda s: n_digits(s).between(13, 20))
    numbers = F.filter(f"{p}loose_phone_any", lambda s: n_digits(s).between(7, 15))
    df = df.withColumn(f"{p}base", base).withColumn(f"{p}more", F.concat(F.col(f"{p}loose_email"), resembling, F.col(f"{p}loose_phone"))).withColumn(f"{p}numbers", numbers)
    df = df.withColumn(f"{p}blocks", F.when((F.size(f"{p}base") > 0) | (F.size(f"{p}more") > 0) | (F.size(f"{p}numbers") > 0), text_blocks(F.col(text).cast("string"))).otherwise(F.array().cast("array<string>")))
    blocks = F.col(f"{p}blocks")

    def valued(s: Column) -> Column:
        before = cut(blocks, F.greatest(F.lit(0), s["start"] - CONTEXT), s["start"])
        after = F.substring(cut(blocks, s["end"], s["end"] + 1), 1, 1)
        return F.struct(s["group"].alias("group"), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text")).alias("span"), F.array(*feature_columns(s["kind"], before, s["text"], after)).alias("v"))

    def reached(numbers: bool) -> str:
        trees, limits = model(numbers)
        return f"{tree_sql(trees, 's.v')} >= array({', '.join(f'{min(limits[k], 1e9)!r}D' for k in KINDS)})[s.span.kind]"

    def tagged(spans: str, group: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(group).alias("group"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text")))

    def uncovered(spans: Column) -> Column:
        """Candidates, with their values, that no base span covers; ``spans``: base spans (group 0) and candidates in order."""
        covered = running(F.transform(spans, lambda s: F.when(s["group"] == 0, s["end"]).otherwise(0)), F.greatest)
        return let(covered, lambda m: F.transform(F.filter(spans, lambda s, i: (s["group"] > 0) & (F.get(m, i) < s["end"])), valued))

    everything = F.array_sort(F.concat(tagged(f"{p}base", 0), tagged(f"{p}more", 1), tagged(f"{p}numbers", 2)))
    df = df.withColumn(f"{p}valued", F.when(F.size(f"{p}more") + F.size(f"{p}numbers") > 0, let(everything, uncovered)))
    more = F.expr(f"coalesce(transform(filter(`{p}valued`, s -> CASE WHEN s.group = 1 THEN {reached(False)} ELSE {reached(True)} END), s -> s.span), array())")
    distinct = lambda spans: F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1) != s))
    df = df.withColumn(f"{p}spans", let(F.array_sort(F.concat(F.col(f"{p}base"), more)), distinct))
    return df.drop(f"{p}text", f"{p}more", f"{p}numbers", f"{p}valued", *(f"{p}{k}" for k in BASE), *(f"{p}loose_{k}" for k in LOOSE))


def joined(spans: str) -> Column:
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, numbers of base spans by kind, digest of the base spans, all spans."""
    found = with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.size(F.filter("pii_base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents``, same columns, with every span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    p = free_prefix(documents.columns, "pii_")
    found = with_spans(documents, text, p)
    names = F.lit([f"[{k.upper()}]" for k in KINDS])
    spans, blocks = F.col(f"{p}spans"), F.col(f"{p}blocks")
    length = F.length(F.col(text).cast("string"))

    def replaced(ends: Column) -> Column:
        """``ends``: where the spans up to each one end. A span that starts before that belongs to the one before it."""
        at = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        parts = F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] >= at(i)), F.concat(cut(blocks, at(i), s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(blocks, F.element_at(ends, -1), length))

    clean = let(running(F.transform(spans, lambda s: s["end"]), F.greatest), replaced)
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).select(*documents.columns)
