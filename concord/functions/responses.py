"""Fields of model responses and of analysis texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed values (fields of an analysis, in order):
FIELDS = ("Source", "Type", "Target Section", "Conflicting Section", "Statement A", "Statement B", "Explanation", "Severity", "Confidence", "NLI Score", "LLM Analysis")
REQUIRED = ("CONTRADICTION FOUND", "Type:", "Conflicting Section:", "Explanation:", "Severity:", "Confidence:")
# Fixed values (defaults and bounds of the parameters):
PARAMETERS = {"top_k": ("int", 2, 8, 5), "alpha": ("double", 0.0, 1.0, 0.5), "min_chunk": ("int", 50, 300, 150), "max_chunk": ("int", 300, 2000, 1000), "min_confidence": ("int", 60, 95, 70)}


def first_group(text: Column, pattern: str, other: Column | str | None = None) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return found if other is None else F.coalesce(found, F.lit(other) if isinstance(other, str) else other)


def confidence(text: Column) -> Column:
    """0 to 100; null if the field is missing."""
    found = first_group(text, r"Confidence:\s*(\d+)").try_cast("int")
    return F.when(found.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), found)))


def severity(text: Column) -> Column:
    return F.initcap(first_group(text, r"(?i)Severity:\s*(High|Medium|Low)", "Low"))


def contradiction_type(text: Column) -> Column:
    return first_group(text, r"(?i)Type:\s*(Direct|Conditional|Exception-based|Numerical|Temporal|Definitional|Scope)", "Direct")


def source(text: Column) -> Column:
    return F.upper(first_group(text, r"(?i)Source:\s*(INTRA|CROSS)", "CROSS"))


def is_valid(text: Column) -> Column:
    """X24."""
    refused = text.contains("NO CONTRADICTION FOUND") | text.contains("API error") | text.contains("max retries")
    valid = ~refused
    for field in REQUIRED:
        valid = valid & text.contains(field)
    return valid


def blocks(text: Column) -> Column:
    """The contradictions of a response, which rules of dashes part."""
    whole = lambda t: t.contains("CONTRADICTION FOUND") & t.contains("Explanation:")
    parts = F.filter(F.transform(F.split(text, r"\n-{3,}\n"), strip), whole)
    parts = F.when((F.size(parts) == 0) & whole(text), F.array(strip(text))).otherwise(parts)
    return F.when(text.contains("NO CONTRADICTION FOUND") & ~text.contains("CONTRADICTION FOUND:"), F.array().cast("array<string>")).otherwise(parts)


def visual(text: Column) -> Column:
    """The fields of a visual finding; null where none was found."""
    line = lambda name: F.trim(F.regexp_extract(text, rf"{name}:\s*(.+?)(?:\n|$)", 1))
    found = text.contains("CONTRADICTION FOUND") & ~text.contains("NO VISUAL-TEXTUAL CONTRADICTION FOUND") & ~text.contains("NO MULTI-HOP VISUAL CONTRADICTION FOUND")
    fields = F.struct(
        first_group(text, r"(?i)Type:\s*(Numerical|Trend|Scope|Categorical|Temporal|Omission)", "Numerical").alias("type"), line("Chart Reference").alias("chart_ref"), line("Text Section").alias("text_section"), line("Chart Claim").alias("chart_claim"), line("Text Claim").alias("text_claim"), line("Hop Chain").alias("hop_chain"),
        strip(F.regexp_extract(text, r"(?s)Explanation:\s*(.+?)(?:\n(?:Severity|Confidence)|$)", 1)).alias("explanation"), severity(text).alias("severity"), F.coalesce(confidence(text), F.lit(60)).alias("confidence"),
    )
    return F.when(found, fields)


def quoted(text: Column, side: str) -> Column:
    """The quoted statement A or B."""
    return strip(F.regexp_extract(text, rf'Statement {side}[^"]*"([^"]+)"', 1))


def field(text: Column, name: str) -> Column:
    """A field's value, up to the next known field; a field's name may carry one remark in brackets."""
    head = lambda f: f.replace("-", r"\-") + r"(?:\s*\([^)]*\))?\s*:"
    others = "|".join(head(f) for f in FIELDS if f != name)
    value = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?s){head(name)}\s*(.*?)(?=\n(?:{others})|\z)", 1)
    return strip(F.regexp_replace(strip(value), '^"+|"+$', ""))


def report_row(analysis: Column, target: Column, related: Column) -> Column:
    """What a report shows of a record; one section is shown for a finding within it, else both."""
    statement = lambda s: F.regexp_replace(field(analysis, s), r"^\([^)]+\)\s*:?\s*", "")
    kind = F.upper(F.coalesce(F.nullif(field(analysis, "Source"), F.lit("")), F.lit("CROSS")))
    inner = F.lower(field(analysis, "Conflicting Section")).contains("same section") | (kind == "INTRA")
    other = F.replace(F.coalesce(related, field(analysis, "Conflicting Section")), F.lit(" (same section)"), F.lit(""))
    pair = F.when(inner, F.concat(target, F.lit(" (intra-section)"))).otherwise(F.concat(target, F.lit("  vs  "), other))
    return F.struct(kind.alias("source"), pair.alias("pair"), statement("Statement A").alias("statement_a"), statement("Statement B").alias("statement_b"), field(analysis, "Explanation").alias("explanation"))


def unfenced(text: Column) -> Column:
    """JSON without the fences that models put around it."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?m)^```[a-z]*\n?", ""), r"(?m)```$", ""))


CHART = "chart_type string, title string, x_axis_label string, y_axis_label string, data_points array<struct<label:string,value:string>>, trends string, key_findings string, raw_description string, confidence double"


def chart(text: Column, page: Column, embedded: Column) -> Column:
    """A chart's fields with defaults and its id; null where the response is no JSON object."""
    data = F.from_json(unfenced(text), CHART)
    title = F.coalesce(data["title"], F.lit(""))
    name = F.concat(F.lit("p"), page.cast("string"), F.lit("_"), title, F.lit("_"), F.when(embedded, "True").otherwise("False"))
    fields = [F.coalesce(data[c], F.lit("")).alias(c) for c in ("x_axis_label", "y_axis_label", "trends", "key_findings", "raw_description")]
    return F.when(
        unfenced(text).rlike(r"(?s)^\{.*\}$") & data.isNotNull(),
        F.struct(F.substring(F.md5(name), 1, 10).alias("chart_id"), page.alias("page_number"), F.coalesce(data["chart_type"], F.lit("other")).alias("chart_type"), title.alias("title"), *fields, F.coalesce(data["data_points"], F.array().cast("array<struct<label:string,value:string>>")).alias("data_points"), F.coalesce(data["confidence"], F.lit(0.5)).alias("confidence")),
    )


def parameters(text: Column, sample: Column) -> Column:
    """Parameters from a JSON response, clamped; defaults for missing ones, and for all if the sample is short or the JSON is bad."""
    data = F.from_json(unfenced(text), ", ".join(f"{k} {v[0]}" for k, v in PARAMETERS.items()) + ", reasoning string")
    usable = (F.length(F.trim(F.substring(sample, 1, 2000))) >= 100) & unfenced(text).rlike(r"(?s)^\{.*\}$")
    own = [F.when(usable, F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(data[k], F.lit(default))))).otherwise(F.lit(default)).alias(k) for k, (_, low, high, default) in PARAMETERS.items()]
    return F.struct(*own, F.lit(2.0).alias("api_delay"), F.substring(F.when(usable, F.coalesce(data["reasoning"], F.lit("Default parameters applied."))).otherwise("Default parameters applied."), 1, 200).alias("reasoning"))


def latin1(text: Column) -> Column:
    """Without characters that core fonts cannot show."""
    plain = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("…"), F.lit("...")), "—–‘’“” •", "--''\"\" -")
    return F.regexp_replace(plain, r"[^\u0000-ÿ]", "")
