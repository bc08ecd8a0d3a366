"""Facts that prose and bare rows state: labels, links between components, criticality, rows known by the place of their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estateloom.functions.keys import col, host_slug, slug
from estateloom.functions.skew import salted_join

_NAME = r"([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)?)"
# How labelled prose states things: the subject, and what is said of it (may be empty).
STATEMENTS = {
    "application": r"Application:\s*([A-Za-z0-9][A-Za-z0-9 /_-]{1,40}?)()(?:\s*[—–-]|\s+is\b|\.|,)",
    "server": r"Server:\s*([a-z0-9][a-z0-9_.-]{1,40})()",
    "database": r"Database:\s*([A-Za-z0-9][A-Za-z0-9_-]{1,40})(?:\s*\(([^)]+)\))?",
    "depends_on": rf"{_NAME}\s+depends on\s+{_NAME}",
    "calls": rf"{_NAME}\s+calls\s+{_NAME}",
    "integrates_with": rf"{_NAME}\s+integrates with\s+{_NAME}",
    "hosted_on": rf"{_NAME}\s+is hosted on server\s+([a-z0-9][a-z0-9_.-]+)",
    "uses": rf"{_NAME}\s+uses\s+(?:database\s+)?([A-Za-z0-9][A-Za-z0-9_-]+)",
    "runs": r"([a-z0-9][a-z0-9_.-]+)\s+runs\s+(Windows Server \d+|RHEL \d+|Ubuntu \d+|Linux|AIX)",
}
# Words that are no name by themselves, and how operating systems are named in cells.
STOPWORDS = ["the", "and", "for", "with", "from", "application", "applications", "service", "server", "database"]
OS_CELL = "Windows Server|RHEL|Ubuntu|Linux|AIX"


def clean_name(c: Column | str, most_words: int = 4) -> Column:
    """A name without marks around it and what follows a dash, "for", "and" or "that"; null if nothing, too long or a common word is left."""
    edges = lambda x: F.regexp_replace(x, r"^[ .|:,;-]+|[ .|:,;-]+$", "")
    cut = edges(F.regexp_extract(edges(col(c)), r"(?s)^(.*?)(?:\s+[—–-]\s+|\s+for\s+|\s+and\s+|\s+that\s+|$)", 1))
    return F.when((F.length(cut) >= 2) & (F.size(F.split(cut, r"\s+")) <= most_words) & ~F.lower(cut).isin(*STOPWORDS), cut)


def statements(texts: DataFrame) -> DataFrame:
    """(kind, subject, object, n_texts, n) of every labelled statement in (text_id, text), all patterns in one scan.

    Subjects are slugs of cleaned names, server names short host names; statements without a usable subject are left out.
    """

    def found(kind: str, pattern: str) -> Column:
        flags = "" if kind in ("depends_on", "calls", "integrates_with", "uses", "hosted_on") else "(?i)"
        groups = F.arrays_zip(F.regexp_extract_all("text", F.lit(flags + pattern), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(flags + pattern), F.lit(2)).alias("b"))
        return F.transform(groups, lambda g: F.struct(F.lit(kind).alias("kind"), g["a"].alias("a"), g["b"].alias("b")))

    rows = texts.where("text is not null").select("text_id", F.inline(F.flatten(F.array(*(found(k, p) for k, p in STATEMENTS.items())))))
    named = rows.withColumn("subject", F.when(F.col("kind").isin("server", "runs"), host_slug("a")).otherwise(slug(clean_name("a"))))
    said = F.when(F.col("kind").isin("depends_on", "calls", "integrates_with", "uses"), slug(clean_name("b"))).when(F.col("kind") == "hosted_on", host_slug("b")).otherwise(F.trim(F.coalesce("b", F.lit(""))))
    return named.withColumn("object", said).where("subject <> '' and object is not null").groupBy("kind", "subject", "object").agg(F.countDistinct("text_id").alias("n_texts"), F.count("*").alias("n"))


def criticality(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, level, confidence, text_id): of each name the first sentence that names it and says "critical", and the level said there, else ``high``.

    ``texts`` is (text_id, text), ``names`` (name) in lower case. Sentences meet names on the first word, salted.
    """
    parts = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    said = texts.where(F.lower("text").contains("critical")).select("text_id", F.posexplode(parts).alias("at", "sentence")).withColumn("low", F.lower("sentence")).where(F.col("low").contains("critical"))
    words = said.select("text_id", "at", "low", F.explode(F.array_distinct(F.split("low", "[^a-z0-9]+"))).alias("word")).where("word <> ''")
    firsts = names.where("name <> ''").distinct().withColumn("word", F.regexp_extract("name", "[a-z0-9]+", 0))
    hits = salted_join(words, firsts, ["word"], ["text_id"], "inner").where(F.col("low").contains(F.col("name")))
    first = hits.groupBy("name").agg(F.min(F.struct("text_id", "at", "low")).alias("f"))
    level = F.nullif(F.regexp_extract("f.low", r"\b(high|medium|low)\b", 1), F.lit(""))
    return first.select("name", F.coalesce(level, F.lit("high")).alias("level"), F.when(level.isNotNull(), 0.75).otherwise(0.6).alias("confidence"), "f.text_id")


def positional_rows(rows: DataFrame) -> DataFrame:
    """(row_id, kind, subject, attribute, value, confidence) from rows of cells without a header: (row_id, cells, inventory).

    A host name before an operating system gives that of the host (less sure where the row says legacy). Five cells or more
    that do not start with a host are read as application, server, database, tier and system.
    """
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    host = F.lower(cell(0)).rlike(r"^[a-z][a-z0-9]*(-[a-z0-9]+)+(\.[a-z0-9-]+)*$")
    legacy = F.lower(F.array_join("cells", " ")).contains("legacy")
    sure = F.when(F.col("inventory"), 0.9).otherwise(0.75)
    row = lambda kind, subject, attribute, value, conf: F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), F.lit(attribute).alias("attribute"), value.alias("value"), conf.alias("confidence"))
    pair = F.array(row("server", host_slug(cell(0)), "os", cell(1), F.when(legacy, 0.55).otherwise(0.8)))
    five = F.array(
        row("application", slug(cell(0)), "name", cell(0), sure), row("application", slug(cell(0)), "hosted_on", host_slug(cell(1)), sure), row("application", slug(cell(0)), "uses", slug(cell(2)), sure),
        row("application", slug(cell(0)), "tier", cell(3), sure), row("server", host_slug(cell(1)), "os", cell(4), sure), row("database", slug(cell(2)), "name", cell(2), sure),
    )
    none = F.array().cast("array<struct<kind:string,subject:string,attribute:string,value:string,confidence:double>>")
    facts = F.when(host & cell(1).rlike(f"(?i){OS_CELL}"), pair).when(~host & (F.size("cells") >= 5) & cell(4).rlike(f"(?i){OS_CELL}"), five).otherwise(none)
    return rows.where("cells is not null").select("row_id", F.inline(facts)).where("value <> '' and subject <> ''")


def cells_of_lines(lines: DataFrame) -> DataFrame:
    """(row_id, cells, inventory) of data lines: cut at the line's first separator, outer quotes and line ends dropped."""
    separator = F.regexp_extract("raw_line", "[,;\t]", 0)
    cells = F.transform(F.split("raw_line", F.when(separator == "", F.lit(",")).otherwise(separator)), lambda c: F.regexp_replace(F.trim(c), '^"|["\r]+$', ""))
    return lines.where("line_no > 1 and raw_line is not null").select(F.col("line_id").alias("row_id"), cells.alias("cells"), (F.col("file_kind") == "fleet-inventory").alias("inventory"))


def empty_kinds(claims: DataFrame) -> DataFrame:
    """(assessment_id, kind): assessments without any claim about applications, servers or databases."""
    kinds = ["application", "server", "database"]
    return claims.groupBy("assessment_id").agg(*(F.count_if(F.col("entity_type") == k).alias(k) for k in kinds)).select(
        "assessment_id", F.explode(F.array_compact(F.array(*(F.when(F.col(k) == 0, F.lit(k)) for k in kinds)))).alias("kind")
    )
