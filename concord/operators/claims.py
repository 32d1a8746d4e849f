"""Claims of a statement: number, unit, metric, entity, population, time (X12-X18), and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positions import after, before, match_spans
from . import gates
from .reconcile import reconcile_pair

# Literal and canonical name, in the order in which they are tried.
METRICS = [
    ("adoption", "adoption_rate"), ("penetration", "adoption_rate"), ("use", "adoption_rate"), ("run", "adoption_rate"), ("deploy", "adoption_rate"), ("deployment", "adoption_rate"), ("pilot", "adoption_rate"),
    ("report", "citation_rate"), ("cited", "citation_rate"), ("concern", "citation_rate"), ("market", "market_size"), ("spend", "market_size"), ("revenue", "market_size"), ("sales", "market_size"), ("size", "market_size"),
    ("cagr", "cagr"), ("compound annual", "cagr"), ("growth rate", "growth_rate"), ("yoy", "yoy_growth"), ("year-over-year", "yoy_growth"), ("share", "share"), ("percent of", "share"), ("of global", "share"), ("of the market", "share"),
    ("savings", "cost_savings"), ("reduction", "cost_reduction"), ("unfilled", "unfilled_roles"), ("salary", "median_salary"), ("compensation", "median_salary"), ("certification", "certifications_issued"),
]
# Fixed values:
UNITS = [
    ("%", "pct"), ("percent", "pct"), ("pct", "pct"), ("pp", "pp"), ("billion", "USD_B"), ("b", "USD_B"), ("trillion", "USD_T"), ("t", "USD_T"), ("million", "USD_M"), ("m", "USD_M"), ("k", "thousands"),
    ("$", "USD"), ("usd", "USD"), ("months", "months"), ("years", "years"),
]
# Fixed values:
ENTITIES = [
    ("public cloud", "public_cloud"), ("public-cloud", "public_cloud"), ("hybrid cloud", "hybrid_cloud"), ("hybrid-cloud", "hybrid_cloud"), ("multi-cloud", "multi_cloud"), ("multicloud", "multi_cloud"), ("edge-cloud", "edge_cloud"), ("edge cloud", "edge_cloud"),
    ("ai workload", "ai_workloads"), ("ai workloads", "ai_workloads"), ("cloud-native", "cloud_native_dev"), ("cloud native", "cloud_native_dev"), ("amazon web services", "aws"), ("aws", "aws"), ("microsoft azure", "azure"), ("azure", "azure"),
    ("google cloud", "gcp"), ("alibaba cloud", "alibaba"), ("oracle cloud", "oracle"), ("ibm cloud", "ibm"), ("top three", "top3_hyperscalers"), ("three largest", "top3_hyperscalers"), ("saas", "saas"), ("paas", "paas"), ("iaas", "iaas"),
    ("north america", "north_america"), ("asia-pacific", "asia_pacific"), ("asia pacific", "asia_pacific"), ("europe", "europe"), ("latin america", "latin_america"), ("middle east & africa", "middle_east_africa"), ("middle east and africa", "middle_east_africa"),
    ("cloud-computing market", "global_cloud_market"), ("cloud computing market", "global_cloud_market"), ("global cloud", "global_cloud_market"), ("security and compliance", "security_compliance_concern"), ("cost predictability", "cost_predictability_concern"),
    ("data egress", "data_egress_concern"), ("talent shortage", "talent_shortage_concern"), ("legacy system", "legacy_integration_concern"),
]
# Fixed values:
POPULATIONS = [
    ("respondents", "survey_respondents"), ("enterprises", "survey_respondents"), ("enterprise respondents", "survey_respondents"), ("companies surveyed", "survey_respondents"), ("organisations", "survey_respondents"), ("organizations", "survey_respondents"),
    ("global cloud spend", "global_cloud_spend"), ("cloud spend", "global_cloud_spend"), ("cloud market", "global_cloud_market"), ("cost stack", "cost_stack"), ("cloud-related roles", "cloud_roles"), ("cloud related roles", "cloud_roles"),
]
# Fixed values:
QUALIFIERS = ["approximately", "roughly", "about", "more than", "less than", "at most", "at least", "around", "up to"]
PROVIDERS = ["aws", "amazon", "azure", "google cloud", "gcp"]
NUMBER_CUES = ["million", "billion", "trillion", "percent", "roles", "enterprise", "respond", "country", "countries", "months", "years", "usd", "share"]
AMOUNT = r"([-−]?)\$?\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|percent|pp|billion|million|trillion|\bB\b|\bM\b|\bT\b|\bK\b|usd|USD|months?|years?|weeks?|days?)?"
AGGREGATE = r"(?i)\b(?:collectively|combined|together|jointly|in\s+aggregate|in\s+total|all\s+(?:three|four|five|told)|top\s+(?:three|five)|sum(?:med)?\s+to)\b"
YEAR = r"\b(?:19|20)\d{2}\b"


def _dictionary(pairs: list[tuple[str, str]]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("lit"), F.lit(b).alias("canon"), F.lit(i).alias("ord")) for i, (a, b) in enumerate(pairs)))


def _ladder(pairs, test) -> Column:
    ladder = None
    for a, b in pairs:
        ladder = F.when(test(a), b) if ladder is None else ladder.when(test(a), b)
    return ladder


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.lit(words), lambda w: F.contains(text, w))


def population(low: Column) -> Column:
    """In dictionary order, a literal that is longer than the name chosen so far takes its place."""
    return F.aggregate(_dictionary(POPULATIONS), F.lit(""), lambda best, d: F.when(F.contains(low, d["lit"]) & (F.length(d["lit"]) > F.length(best)), d["canon"]).otherwise(best))


def _place(text: Column, literal: Column) -> Column:
    """Where the literal first occurs, from 1; 0 if nowhere."""
    return F.call_function("instr", text, literal)


def nearest_entity(low: Column, start: Column, end: Column) -> Column:
    """The entity that ends last before the number (within 60), else begins first after it (within 25), else the longest.

    A literal's last place in the text before the number is its first place in that text reversed.
    """
    head, tail = F.substring(low, F.lit(1), start), F.substring(low, end + 1, F.length(low))
    here = lambda text: F.filter(_dictionary(ENTITIES), lambda d: F.contains(text, d["lit"]))
    last = F.array_max(F.transform(here(head), lambda d: F.struct((1 - _place(F.reverse(head), F.reverse(d["lit"]))).alias("gap"), (-d["ord"]).alias("first"), d["canon"].alias("canon"))))
    next_ = F.array_min(F.transform(here(tail), lambda d: F.struct((_place(tail, d["lit"]) - 1).alias("gap"), d["ord"].alias("ord"), d["canon"].alias("canon"))))
    longest = F.array_max(F.transform(here(low), lambda d: F.struct(F.length(d["lit"]).alias("n"), (-d["ord"]).alias("first"), d["canon"].alias("canon"))))
    return F.when(-last["gap"] < 60, last["canon"]).when(next_["gap"] < 25, next_["canon"]).otherwise(F.coalesce(longest["canon"], F.lit("")))


def metric(low: Column, unit: Column) -> Column:
    """The first literal of the dictionary that the text holds, else by unit and cue words."""
    percent = F.when(_any(low, ["run", "use", "deploy", "adopt", "operate"]), "adoption_rate").when(_any(low, ["cite", "name", "report", "concern"]), "citation_rate").when(_any(low, ["share", "of global", "of the market"]), "share").otherwise("percentage")
    money = F.when(_any(low, ["save", "saving"]), "cost_savings").when(_any(low, ["revenue", "sales"]), "revenue").otherwise("market_size")
    by_unit = F.when(unit == "pct", percent).when(unit.isin("USD_B", "USD_T", "USD_M", "USD"), money).when(unit.isin("months", "years"), "duration").when(unit == "pp", "percentage_point_gap").otherwise("unknown")
    return F.coalesce(_ladder(METRICS, lambda lit: low.contains(lit)), by_unit)


def claim_rows(statements: DataFrame, *keys: str, text: str = "statement") -> DataFrame:
    """A row per number that has a unit: keys, ord, value, unit, metric, entity, population, year, qualifier, confidence."""
    df = statements.select(*keys, F.col(text).alias("s"), F.lower(text).alias("low"), F.posexplode(match_spans(F.col(text), AMOUNT)).alias("ord", "m"))
    df = df.where(~F.trim("m.raw").rlike(r"^(?:19|20)\d{2}$"))
    part = lambda g: F.regexp_extract("m.raw", AMOUNT, g)
    value = F.regexp_replace(part(2), ",", "").cast("double") * F.when(part(1) == "", 1).otherwise(-1)
    unit_word = F.lower(part(3))
    df = df.withColumn("value", value).withColumn("own", _ladder(UNITS, lambda u: unit_word == u))
    left, right, tail = F.lower(before(F.col("s"), F.col("m.start"), 20)), F.lower(after(F.col("s"), F.col("m.end"), 20)), F.lower(after(F.col("s"), F.col("m.end"), 25))
    cue = _any(left, NUMBER_CUES) | _any(right, NUMBER_CUES)
    from_tail = _ladder(UNITS, lambda u: tail.rlike(rf"\b{_escaped(u)}\b"))
    df = df.withColumn("unit", F.coalesce("own", F.when(cue, from_tail))).where(F.col("unit").isNotNull())
    window = F.substring("s", F.greatest(F.lit(1), F.col("m.start") + 1 - 60), F.col("m.end") - F.greatest(F.lit(0), F.col("m.start") - 60))
    providers = F.size(F.filter(F.lit(PROVIDERS), lambda p: F.contains(F.col("low"), p)))
    entity = F.when(window.rlike(AGGREGATE), F.when(providers >= 2, "top3_hyperscalers").otherwise("aggregate")).otherwise(nearest_entity(F.col("low"), F.col("m.start"), F.col("m.end")))
    df = df.withColumn("entity", entity).withColumn("metric", metric(F.col("low"), F.col("unit"))).withColumn("population", population(F.col("low")))
    df = df.withColumn("year", F.regexp_extract("s", YEAR, 0).try_cast("int")).withColumn("qualifier", F.coalesce(_ladder([(x, x) for x in QUALIFIERS], lambda x: F.col("low").contains(x)), F.lit("")))
    add = lambda condition, by: F.when(condition, by).otherwise(0.0)
    score = F.lit(0.4) + add(F.col("entity") != "", 0.15) + add(F.col("metric") != "unknown", 0.2) + F.lit(0.15) + add(F.col("population") != "", 0.10)
    return df.select(*keys, "ord", "value", "unit", "metric", "entity", "population", "year", "qualifier", F.least(F.lit(0.95), score).alias("confidence"))


def _escaped(literal: str) -> str:
    return literal.replace("$", r"\$")


def comparable(a: Column, b: Column) -> Column:
    """Same metric, entity and unit; time and population alike unless one side lacks it."""
    same = lambda f: F.coalesce(a[f] == b[f], F.lit(True))
    population = (a["population"] == "") | (b["population"] == "") | (a["population"] == b["population"])
    return (a["metric"] == b["metric"]) & (a["entity"] == b["entity"]) & (a["unit"] == b["unit"]) & same("year") & population


def contradict(a: Column, b: Column, tolerance: float = 0.03) -> Column:
    """P13."""
    return comparable(a, b) & (gates.relative_gap(a["value"], b["value"]) > tolerance)


def contradicting_claims(claims: DataFrame, group: str) -> DataFrame:
    """Pairs of claims of different statements of a group. An equi-join on metric, entity and unit with the rest as residue.
    ``claims``: group, stmt_idx, and what ``claim_rows`` gives."""
    names = ("stmt_idx", "ord", "value", "year", "population")
    side = lambda x: claims.select(group, "metric", "entity", "unit", *(F.col(c).alias(f"{c}_{x}") for c in names))
    same_year = F.coalesce(F.col("year_a") == F.col("year_b"), F.lit(True))
    same_population = (F.col("population_a") == "") | (F.col("population_b") == "") | (F.col("population_a") == F.col("population_b"))
    joined = side("a").join(side("b"), [group, "metric", "entity", "unit"]).where(F.col("stmt_idx_a") < F.col("stmt_idx_b")).where(same_year & same_population)
    return joined.withColumn("gap", gates.relative_gap(F.col("value_a"), F.col("value_b")))


def precision_gate(pairs: DataFrame, claims: DataFrame, group: str = "chunk_id", tolerance: float = 0.03, other: str | None = None, universe: str | None = None) -> DataFrame:
    """(pairs' columns, keep, stage, reason, gap) of pairs (group, i, j, role_a, role_b, passed).

    ``claims``: group, stmt_idx, and what ``claim_rows`` gives. The first contradiction of claims, in their order, keeps a pair, unless the
    numbers of ``universe`` (a column of ``pairs``, optional) reconcile its two values; claims on both sides of which none compare drop
    it; else a polarity signal decides. ``other``: the column that holds the group of statement j, where pairs run across groups.

    Only the keys of pairs meet the claims: two equi-joins, the second on metric, entity and unit as well.
    """
    keys = [group, "i", "j"] if other is None else [group, other, "i", "j"]
    at_b = other or group
    same = ("metric", "entity", "unit")
    side = lambda g, n, x: claims.select(F.col(group).alias(g), F.col("stmt_idx").alias(n), *same, *(F.col(c).alias(f"{c}_{x}") for c in ("ord", "value", "year", "population")))
    same_year = F.coalesce(F.col("year_a") == F.col("year_b"), F.lit(True))
    same_population = (F.col("population_a") == "") | (F.col("population_b") == "") | (F.col("population_a") == F.col("population_b"))
    compared = pairs.select(*keys).join(side(group, "i", "a"), [group, "i"]).join(side(at_b, "j", "b"), [at_b, "j", *same]).where(same_year & same_population)
    gap = gates.relative_gap(F.col("value_a"), F.col("value_b"))
    best = compared.withColumn("gap", gap).groupBy(*keys).agg(F.min(F.when(F.col("gap") > tolerance, F.struct("ord_a", "ord_b", "gap", "value_a", "value_b"))).alias("first"), F.lit(True).alias("compared"))
    having = claims.select(group, "stmt_idx").distinct()
    has = lambda g, n, x: having.select(F.col(group).alias(g), F.col("stmt_idx").alias(n), F.lit(True).alias(x))
    df = pairs.join(best, keys, "left").join(has(group, "i", "has_a"), [group, "i"], "left").join(has(at_b, "j", "has_b"), [at_b, "j"], "left")
    mismatch = ~gates.compatible(F.col("role_a"), F.col("role_b"))
    incomparable = F.col("has_a").isNotNull() & F.col("has_b").isNotNull() & F.col("compared").isNull()
    relation = F.lit(None).cast("string")
    if universe is not None:
        relation = F.when(F.col("first").isNotNull() & (F.size(universe) > 0), reconcile_pair(F.col("first.value_a"), F.col("first.value_b"), F.col(universe)))
    df = df.withColumn("relation", relation)
    reconciled = F.col("relation").isNotNull()
    stage = F.when(mismatch, "role").when(reconciled, "reconciler").when(F.col("first").isNotNull(), "claim").when(incomparable, "claim").when(~F.col("passed"), "negation_gate").otherwise("all_passed")
    reason = F.when(mismatch, "role_mismatch").when(reconciled, F.concat(F.lit("arithmetic_reconciled: "), "relation")).when(F.col("first").isNotNull(), "claim_contradiction").when(incomparable, "no_comparable_claims").when(~F.col("passed"), "no_polarity_signal").otherwise("gates_passed")
    df = df.withColumn("stage", stage).withColumn("reason", reason).withColumn("keep", F.col("reason").isin("claim_contradiction", "gates_passed"))
    return df.withColumn("gap", F.when(F.col("reason") == "claim_contradiction", F.col("first.gap"))).drop("first", "compared", "has_a", "has_b", "relation")


def universe(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, universe): the distinct numbers of 1 or more in magnitude that are no bare years, ascending."""
    numbers = texts.select(key, F.explode(gates.extract(F.col(text), gates.NUMBER_OR_PERCENT)).alias("t")).select(key, gates.to_number(F.col("t")).alias("v"))
    kept = numbers.where((F.abs("v") >= 1) & ~(F.col("v").between(1900, 2099) & (F.col("v") == F.floor("v"))))
    return kept.groupBy(key).agg(F.array_sort(F.collect_set("v")).alias("universe"))
