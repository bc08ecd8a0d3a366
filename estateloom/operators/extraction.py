"""Facts out of prose and manifests, and scans for what must not pass: regular expressions inside the scan, then grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estateloom.functions.keys import col, slug

# Patterns of the scans.
#: word boundaries are those of a-z, 0-9 and _, so that text of other scripts may touch a match
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
EMAIL = rf"{_B}\w[\w.+-]*@[\w-]+\.[\w.-]*\w{_E}"
IPV4 = rf"{_B}(?:\d{{1,3}}\.){{3}}\d{{1,3}}{_E}"
PHONE = rf"{_B}(?:\d{{1,2}}[\s.-]?)?\(?\d{{3}}\)?[\s.-]\d{{3}}[\s.-]\d{{4}}{_E}"
INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions",
    r"disregard\s+(all\s+)?(previous|prior|above)",
    r"you\s+are\s+now\s+(?:dan|jailbroken|unrestricted)",
    r"system\s*prompt\s*:",
    r"<\s*/?\s*system\s*>",
    r"\[\s*INST\s*\]",
    r"do\s+not\s+follow\s+your\s+(?:system|safety)\s+rules",
    r"override\s+(?:safety|guardrails?|content\s+policy)",
    r"reveal\s+(?:your\s+)?(?:system\s+)?prompt",
    r"exfiltrat(?:e|ion)",
    r"#\s*(?:ai|llm|assistant)\s*[:,]\s*ignore",
    r"//\s*(?:ai|llm|assistant)\s*[:,]\s*ignore",
    r'"description"\s*:\s*"[^"]*ignore\s+(?:previous|prior|above)\s+instructions',
]
HARM = {"violence": r"\b(?:how\s+to\s+(?:make|build)\s+a\s+bomb|kill\s+all)\b", "self_harm": r"\b(?:suicide\s+methods?|how\s+to\s+harm\s+myself)\b"}
CREDENTIAL = r"\b(?:password|api[_-]?key|secret[_-]?key|private[_-]?key|connectionstring)\b.{0,40}(?:['\"][^'\"]{8,}['\"]|[:=]\s*\S{8,})"
NAME = r"[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)?"
RELATION = rf"({NAME}) (depends on|calls|integrates with|talks to) ({NAME})"
RUNS = r"([a-z0-9][a-z0-9_-]*-[a-z0-9_-]+) runs ([A-Z][A-Za-z0-9]+) ([0-9][0-9.]*[0-9]) on ([A-Z]+ [0-9]+)"
REQUIREMENTS = [
    ("nfr", r"(?i)NFR:\s*([^\n]+)"),
    ("sla", r"(?i)SLA:\s*([^\n]+)"),
    ("availability", r"(?i)availability[^.\n]{0,40}?(\d{2,3}\.?\d*%|99\.9+%)"),
    ("rto", r"(?i)RTO[:\s]+([^\n,]{2,40})"),
    ("rpo", r"(?i)RPO[:\s]+([^\n,]{2,40})"),
    ("latency", r"(?i)latency[^.\n]{0,40}?(\d+\s*ms)"),
    ("data_residency", r"(?i)data residency[:\s]+([^\n.]{2,60})"),
    ("nfr", r"(?i)must support[:\s]+([^\n.]{2,80})"),
    ("compliance", r"(?i)(PCI(?:-DSS)?|HIPAA|SOC\s*2|ISO\s*27001)"),
    ("encryption", r"(?i)encrypt(?:ion|ed)[:\s]+([^\n.]{2,60})"),
    ("scalability", r"(?i)peak load[:\s]+([^\n.]{2,60})"),
    ("scalability", r"(?i)concurrent users[:\s]+([^\n.]{2,40})"),
]
#: one cell that states both recovery targets; it is read first, and the patterns above do not see it
BOTH_TARGETS = r"(?i)RTO\s*/\s*RPO[:\s|]+([^/\n]{2,40}?)\s*/\s*([^\n,.;|]{2,40})"


def _all(text: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def dependency_edges(documents: DataFrame) -> DataFrame:
    """(source, relation, target) of sentences that say so: documents and mentions of each edge."""
    found = documents.select("doc_id", F.inline(F.arrays_zip(_all("text", RELATION, 1).alias("a"), _all("text", RELATION, 2).alias("r"), _all("text", RELATION, 3).alias("b"))))
    relation = F.when(F.col("r").contains("depend"), "depends_on").otherwise("calls")
    return found.groupBy(slug("a").alias("source"), relation.alias("relation"), slug("b").alias("target")).agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_mentions"))


def runtime_facts(documents: DataFrame) -> DataFrame:
    """(host, software, version, platform, n): what prose says runs where."""
    zipped = F.arrays_zip(*(_all("text", RUNS, i).alias(n) for i, n in enumerate(("host", "software", "version", "platform"), 1)))
    return documents.select("doc_id", F.inline(zipped)).groupBy("host", "software", "version", "platform").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


def requirement_facts(documents: DataFrame) -> DataFrame:
    """(requirement, value, n, n_documents) of every pattern, all in one scan; a cell of both recovery targets is taken apart first."""

    def named(name: str, text: str, pattern: str, group: int = 1) -> Column:
        return F.transform(_all(text, pattern, group), lambda v: F.struct(F.lit(name).alias("requirement"), F.trim(v).alias("value")))

    rest = documents.where("text is not null").select("doc_id", "text", F.regexp_replace("text", BOTH_TARGETS, " ").alias("rest"))
    found = F.flatten(F.array(named("rto", "text", BOTH_TARGETS, 1), named("rpo", "text", BOTH_TARGETS, 2), *(named(a, "rest", p) for a, p in REQUIREMENTS)))
    return rest.select("doc_id", F.inline(found)).where(F.length("value") >= 2).groupBy("requirement", "value").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


def contact_counts(documents: DataFrame) -> DataFrame:
    """Per document: e-mail, address and telephone forms, and the text with them replaced, as a hash."""
    red = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", EMAIL, "[REDACTED_EMAIL]"), IPV4, "[REDACTED_IPV4]"), PHONE, "[REDACTED_PHONE]")
    count = lambda p: F.size(_all("text", p, 0))
    return documents.where("text is not null").select("doc_id", count(EMAIL).alias("n_email"), count(IPV4).alias("n_ipv4"), count(PHONE).alias("n_phone"), F.md5(red).alias("redacted"))


def guarded(texts: DataFrame) -> DataFrame:
    """(origin, n, n_injection, n_credential) over (origin, text): what a gate in front of a model would see."""
    injected = F.exists(F.array(*(F.lit(f"(?i){p}") for p in INJECTION)), lambda p: F.regexp_like("text", p))
    return texts.where("text is not null").groupBy("origin").agg(F.count("*").alias("n"), F.count_if(injected).alias("n_injection"), F.count_if(F.col("text").rlike(f"(?i){CREDENTIAL}")).alias("n_credential"))


def harmful(texts: DataFrame) -> DataFrame:
    """(origin, category, n) over (origin, text): texts that speak of harm to others or to oneself, by category; categories without one count 0."""
    counts = texts.where("text is not null").groupBy("origin").agg(*(F.count_if(F.col("text").rlike(f"(?i){p}")).alias(c) for c, p in HARM.items()))
    return counts.select("origin", F.inline(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in HARM))))


def token_stats(documents: DataFrame) -> DataFrame:
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return documents.where("text is not null").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.coalesce(F.array_max(F.transform(t, lambda x: F.length(x))), F.lit(0)).alias("longest"))


def open_questions(documents: DataFrame) -> DataFrame:
    """Questions that texts ask, once per key (lower case, other characters than a-z and 0-9 as one blank, 240 at most)."""
    q = documents.select("doc_id", F.explode(_all("text", r"[^.!?\n]*\?", 0)).alias("question"))
    key = F.left(F.trim(F.regexp_replace(F.lower("question"), "[^a-z0-9]+", " ")), F.lit(240))
    return q.withColumn("key", key).where(F.length("key") >= 8).groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


# Directory names that say nothing of the component inside.
GENERIC_DIRECTORIES = ["apps", "services", "cache", "releases", "objects", "snap", "bak", "clone", "src", "lib", "config", "deploy", "infra", "k8s", "helm", "docker", "scripts", "ci", "test", "fixtures", "password-reset"]


def manifest_kind(path: Column | str) -> Column:
    name = F.lower(F.substring_index(col(path), "/", -1))
    return (
        F.when(name == "package.json", "npm").when(name == "package-lock.json", "npm-lock").when(name.startswith("dockerfile"), "docker").when(name.startswith("docker-compose"), "compose").when(name.startswith(".env"), "env")
        .when(name.rlike(r"\.(properties|ini|npmrc|tfvars)$"), "settings").when(name.rlike(r"^appsettings.*\.json$"), "dotnet").when(name == "pom.xml", "maven").when(name.rlike(r"\.csproj$"), "csproj").when(name.rlike(r"^build\.gradle"), "gradle").when(name == "pyproject.toml", "pyproject").when(name.rlike(r"\.(xml|config)$"), "xml").when(name.rlike(r"\.ya?ml$"), "yaml")
        .when(name.rlike(r"\.sh$"), "shell").when(name.rlike(r"\.js$"), "code").when(name == "requirements.txt", "pip").otherwise("other")
    )


def component(path: Column | str) -> Column:
    """The nearest directory from the root whose name says something; a kept path without one gives ``root``."""
    parts = F.split(col(path), "/")
    named = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.isin(*GENERIC_DIRECTORIES) & p.rlike("^[a-z][a-z-]*$"))
    return F.coalesce(F.get(named, F.lit(0)), F.lit("root"))


def manifest_inventory(files: DataFrame) -> DataFrame:
    return files.groupBy(manifest_kind("relative_path").alias("kind"), component("relative_path").alias("component")).agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


# Words that point to gaps in what is known.
GAP_SIGNALS = {"card data": "pci", "health data": "hipaa", "undocumented": "not documented|known gaps", "no backup": "no backup|lack a backup", "unknown owner": "owner is unknown|nobody"}


def gap_signals(documents: DataFrame) -> DataFrame:
    """(signal, n_documents, first_doc): all signals in one scan."""
    hits = F.array_compact(F.array(*(F.when(F.lower("text").rlike(p), F.lit(s)) for s, p in GAP_SIGNALS.items())))
    return documents.where("text is not null").select("doc_id", F.explode(hits).alias("signal")).groupBy("signal").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"))


def thin_documents(documents: DataFrame, least_chars: int = 40) -> DataFrame:
    """(assessment_id, n, n_thin, chars): documents of which too little text came out, per assessment."""
    size = F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    return documents.groupBy("assessment_id").agg(F.count("*").alias("n"), F.count_if(size < least_chars).alias("n_thin"), F.sum(size).alias("chars"))
