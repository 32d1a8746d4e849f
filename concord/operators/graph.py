"""The graph of sections that contradict each other (G1-G20). Edges: doc_name, edge_ord, src, dst, confidence, severity, type.

Paths may pass a node twice but no edge, so a path carries the ids of its edges. Path lengths are bounded, and each
step is one equi-join on (doc_name, node).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DECAY = 0.7

# Fixed values (pattern and name of the entities; texts are lower-cased first, so capitals in a pattern never match):
ENTITIES = [
    (r"\b(?:MFA|multi-factor authentication)\b", "MFA"), (r"\b(?:VPN|virtual private network)\b", "VPN"), (r"\bpassword[s]?\b", "Password"), (r"\b(?:encryption|encrypted)\b", "Encryption"), (r"\b(?:security audit[s]?|audit[s]?)\b", "Audit"), (r"\bfirewall[s]?\b", "Firewall"),
    (r"\b(?:remote work|work remotely|working remotely)\b", "Remote Work"), (r"\b(?:work(?:ing)? hours|core hours)\b", "Work Hours"), (r"\b(?:flexible scheduling|flexible hours)\b", "Flexible Scheduling"), (r"\b(?:leave|time[- ]off)\b", "Leave Policy"), (r"\b(?:monitoring|screen tracking)\b", "Monitoring"), (r"\b(?:compliance|comply)\b", "Compliance"),
    (r"\b(?:sensitive data|confidential)\b", "Sensitive Data"), (r"\b(?:local storage|stored locally)\b", "Local Storage"), (r"\b(?:cloud|centralized)\b", "Cloud Storage"), (r"\b(?:personal device[s]?|BYOD)\b", "Personal Devices"), (r"\bcompany[- ]issued device[s]?\b", "Company Devices"),
    (r"\bemail\b", "Email"), (r"\b(?:instant messaging|messaging apps)\b", "Messaging"), (r"\bpublic Wi-?Fi\b", "Public WiFi"), (r"\bemployee[s]?\b", "Employees"), (r"\bmanager[s]?\b", "Managers"), (r"\bintern[s]?\b", "Interns"), (r"\b(?:contractor?[s]?|contract employee[s]?)\b", "Contractors"),
]


def entities(text, any_case: bool = False):
    """The names of the entities in a text, in order; ``any_case``: acronyms match too."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*(F.when(low.rlike(("(?i)" if any_case else "") + p), F.lit(n)) for p, n in ENTITIES))))


def last_written(writes: DataFrame) -> DataFrame:
    """One edge per (doc_name, src, dst) with the values of its last write; the mark of one section is cut from dst."""
    own = writes.withColumn("dst", F.regexp_replace("dst", r" \(same section\)", ""))
    last = own.groupBy("doc_name", "src", "dst").agg(F.max_by(F.struct("edge_ord", "confidence", "severity", "type"), "edge_ord").alias("v"))
    return last.select("doc_name", "src", "dst", "v.*")


def section_totals(writes: DataFrame) -> DataFrame:
    """Count, highest score and types (in order of arrival, repeats kept) per (doc_name, src, dst)."""
    own = writes.withColumn("dst", F.regexp_replace("dst", r" \(same section\)", ""))
    types = F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", "type"))), lambda x: x["type"])
    return own.groupBy("doc_name", "src", "dst").agg(F.count("*").alias("n"), (F.max("confidence") / 100).alias("max_score"), types.alias("types"))


def walks(edges: DataFrame, most: int, starts: DataFrame | None = None) -> list[DataFrame]:
    """All paths of 1 to ``most`` edges: doc_name, first, last, path, used (edge ids), confs."""
    e = edges.select("doc_name", F.col("src").alias("last"), F.col("dst").alias("next"), F.col("edge_ord").alias("edge"), F.col("confidence").alias("conf"))
    current = e.select("doc_name", F.col("last").alias("first"), F.col("next").alias("last"), F.array("last", "next").alias("path"), F.array("edge").alias("used"), F.array("conf").alias("confs"))
    if starts is not None:
        current = current.join(starts, ["doc_name", "first"], "left_semi")
    found = [current]
    for _ in range(most - 1):
        step = found[-1].join(e, ["doc_name", "last"]).where(~F.array_contains("used", F.col("edge")))
        found.append(step.select("doc_name", "first", F.col("next").alias("last"), F.array_append("path", F.col("next")).alias("path"), F.array_append("used", F.col("edge")).alias("used"), F.array_append("confs", F.col("conf")).alias("confs")))
    return found


def chains(edges: DataFrame, least: int = 2, most: int = 5, limit: int = 30) -> DataFrame:
    """The longest, then most certain paths between different sections of each document."""
    paths = reduce(DataFrame.unionByName, walks(edges, most)[least - 1 :]).where("first != last")
    scored = paths.select("doc_name", F.array_join("path", ">").alias("chain"), F.size("used").alias("depth"), F.least(F.lit(100), F.array_min("confs")).alias("min_confidence"), F.array_join("used", ",").alias("edges"))
    place = F.row_number().over(Window.partitionBy("doc_name").orderBy(F.desc("depth"), F.desc("min_confidence"), "chain", "edges"))
    return scored.withColumn("place", place).where(F.col("place") <= limit)


def loops(edges: DataFrame, most: int = 6, limit: int = 10) -> DataFrame:
    """The shortest distinct circles of each document; turned circles are different rows."""
    found = reduce(DataFrame.unionByName, walks(edges, most)[1:]).where("first = last").select("doc_name", F.array_join("path", ">").alias("loop"), F.size("used").alias("size")).distinct()
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_name").orderBy("size", "loop"))).where(F.col("place") <= limit)


def risk(edges: DataFrame, starts: DataFrame, most: int = 4) -> DataFrame:
    """Every path from the starting sections (doc_name, first) with its score: the product of its confidences, decayed per hop."""
    paths = reduce(DataFrame.unionByName, walks(edges, most, starts)).where("first != last")
    product = F.aggregate("confs", F.lit(1.0), lambda p, c: p * (c / 100.0))
    hops = F.size("used")
    return paths.select("doc_name", F.col("last").alias("section"), hops.alias("hops"), F.round(product * F.pow(F.lit(DECAY), hops - 1) * 100).alias("propagation_score"), F.array_join("path", ">").alias("path"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end; a loop once. Columns doc_name, section, other, edge_ord, confidence."""
    out = edges.select("doc_name", F.col("src").alias("section"), F.col("dst").alias("other"), "edge_ord", "confidence")
    back = edges.where("src != dst").select("doc_name", F.col("dst").alias("section"), F.col("src").alias("other"), "edge_ord", "confidence")
    return out.unionByName(back)


def hotspots(edges: DataFrame, limit: int = 10) -> DataFrame:
    """G12."""
    own = both_ways(edges).groupBy("doc_name", "section").agg(F.count("*").alias("degree"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("conflicts_with"), F.avg("confidence").alias("avg_confidence"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("doc_name").orderBy(F.desc("degree"), "section"))).where(F.col("place") <= limit)


def summary(sections: DataFrame, edges: DataFrame) -> DataFrame:
    """Sections (doc_name, section), edges, mean confidence over what each section sees."""
    seen = sections.join(both_ways(edges), ["doc_name", "section"], "left")
    return seen.groupBy("doc_name").agg(F.countDistinct("section").alias("sections"), F.countDistinct("edge_ord").alias("edges"), F.coalesce(F.bround(F.avg("confidence"), 1), F.lit(0.0)).alias("avg_confidence"))


def nodes(sections: DataFrame, edges: DataFrame) -> DataFrame:
    """Every section with its degree and the worst severity next to it; sections without edges stay."""
    rank = F.when(F.col("severity") == "High", 3).when(F.col("severity") == "Medium", 2).otherwise(1)
    worst = edges.select("doc_name", "edge_ord", rank.alias("worst"))
    seen = sections.join(both_ways(edges).join(worst, ["doc_name", "edge_ord"]), ["doc_name", "section"], "left")
    return seen.groupBy("doc_name", "section").agg(F.countDistinct("edge_ord").alias("degree"), F.coalesce(F.max("worst"), F.lit(0)).alias("worst")).withColumn("size", 14 + 6 * F.col("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair, the most confident, the first of equals."""
    place = F.row_number().over(Window.partitionBy("doc_name", F.least("src", "dst"), F.greatest("src", "dst")).orderBy(F.desc("confidence"), "edge_ord"))
    return edges.withColumn("place", place).where("place = 1").drop("place")


def open_triangles(edges: DataFrame) -> DataFrame:
    """A to B to C where A and C are different and not joined in either direction."""
    a = edges.select("doc_name", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("confidence").alias("ab"), F.col("edge_ord").alias("e1"))
    b = edges.select("doc_name", F.col("src").alias("b"), F.col("dst").alias("c"), F.col("confidence").alias("bc"), F.col("edge_ord").alias("e2"))
    two = a.join(b, ["doc_name", "b"]).where("a != c and e1 != e2")
    direct = edges.select("doc_name", F.col("src").alias("a"), F.col("dst").alias("c")).distinct()
    return two.join(direct, ["doc_name", "a", "c"], "left_anti").join(direct.select("doc_name", F.col("c").alias("a"), F.col("a").alias("c")), ["doc_name", "a", "c"], "left_anti").drop("e1", "e2")


def entity_clusters(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Per entity the number of (edge, mention of its source) and up to three of its statements, the first by alphabet.

    ``mentions``: doc_name, src, entity, statement.
    """
    joined = mentions.join(edges.select("doc_name", "src", "edge_ord"), ["doc_name", "src"])
    return joined.groupBy("doc_name", "entity").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("statement")), 1, 3).alias("samples"))


def stats(sections: DataFrame, statements: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per document, documents without any of a kind included."""
    counts = [df.groupBy("doc_name").agg(c.alias(n)) for df, n, c in ((statements, "statements", F.count("*")), (mentions, "entities", F.countDistinct("entity")), (mentions, "mention_edges", F.count("*")), (edges, "contradiction_edges", F.count("*")))]
    return reduce(lambda x, y: x.join(y, "doc_name", "left"), counts, sections.groupBy("doc_name").agg(F.count("*").alias("sections"))).fillna(0)


def compare(edges: DataFrame, one: str, other: str) -> DataFrame:
    """Edges from sections of one document to those of another (columns doc_name, other_doc)."""
    return edges.where((F.col("doc_name") == one) & (F.col("other_doc") == other)).select("src", "dst", "severity", "confidence", "type")


def resolve(quotes: DataFrame, statements: DataFrame, n: int = 80) -> DataFrame:
    """For each quote (doc_name, quote_id, quote) the first statement (by chunk_id, stmt_idx) that contains its first n characters.

    Candidates are paired on document and on the quote's longest word, which a statement that contains the quote's beginning also
    holds, so the substring test runs on few pairs.
    """
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))
    start = F.substring("quote", 1, n)
    inner = F.regexp_replace(F.lower(start), r"^[a-z0-9]+|[a-z0-9]+$", "")  # a word cut at either end is no key
    key = F.array_max(F.transform(words(inner), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = quotes.withColumn("word", F.coalesce(key, F.lit("")))  # quotes without such a word meet all statements of their document
    rows = statements.select("doc_name", "chunk_id", "stmt_idx", "statement", F.explode(F.array_append(F.array_distinct(words(F.col("statement"))), F.lit(""))).alias("word"))
    found = asked.join(rows, ["doc_name", "word"]).where(F.contains("statement", start))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_name", "quote_id").orderBy("chunk_id", "stmt_idx"))).where("place = 1").drop("place", "word")
