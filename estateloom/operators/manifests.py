"""Manifests of code: what they depend on, which component owns a file, contexts that are built, and quotes found again in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estateloom.functions import inventory as I
from estateloom.functions.skew import salted_join
from estateloom.operators.evidence import flattened
from estateloom.operators.extraction import component, manifest_kind

# By kind of manifest how it names things: what it is, and a pattern of name and version (may be empty).
FORMS = [
    ("npm", "package", r'"(@?[a-z0-9][a-z0-9._/@-]*)"\s*:\s*"[\^~>=<v]*\s*([0-9]+\.[0-9A-Za-z.+-]*)"'),
    ("maven", "package", r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)\s*</artifactId>\s*(?:<version>\s*([^<\s]*)\s*</version>)?"),
    ("gradle", "package", r"""(?:implementation|api|compileOnly|runtimeOnly|testImplementation|compile)\s*\(?\s*["'][^:"']+:([^:"']+)(?::([^"']+))?["']"""),
    ("pip", "package", r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?[ \t]*(?:==|>=|<=|~=|>|<)[ \t]*([0-9][0-9A-Za-z.*]*)"),
    ("pyproject", "package", r"""["']([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?[ \t]*(?:==|>=|<=|~=|>|<)[ \t]*([0-9][0-9A-Za-z.*]*)"""),
    ("csproj", "package", r'<PackageReference\s+Include="([^"]+)"(?:\s+Version="([^"]*)")?'),
    ("docker", "base", r"(?mi)^[ \t]*FROM[ \t]+(?:--platform=[^ ]+[ \t]+)?([a-z0-9][a-z0-9./_-]*)(?::([A-Za-z0-9_.-]+))?"),
    ("docker", "port", r"(?mi)^[ \t]*EXPOSE[ \t]+([0-9]+)()"),
    ("compose", "image", r"(?m)^[ \t]*image:[ \t]*[\"']?([a-z0-9][a-z0-9./_-]*)(?:[:@]([A-Za-z0-9_.:-]+))?"),
    ("yaml", "image", r"(?m)^[ \t]*image:[ \t]*[\"']?([a-z0-9][a-z0-9./_-]*)(?:[:@]([A-Za-z0-9_.:-]+))?"),
    ("compose", "host", r"(?m)^[ \t]*[A-Za-z_]*[hH]ost(?:name)?:[ \t]*[\"']?([a-z0-9][a-z0-9.-]*)()"),
    ("yaml", "host", r"(?m)^[ \t]*[A-Za-z_]*[hH]ost(?:name)?:[ \t]*[\"']?([a-z0-9][a-z0-9.-]*)()"),
    ("dotnet", "host", r"(?i)(?:Server|Data Source|Host)=([A-Za-z0-9][A-Za-z0-9.-]*)()"),
    ("env", "host", r"(?m)^[ \t]*(?:export[ \t]+)?[A-Z][A-Z0-9_]*(?:HOST|URL|URI|ENDPOINT|SERVER)[ \t]*=[ \t]*[\"']?(?:[a-z+]+://)?(?:[^@ \t\n/]*@)?([A-Za-z0-9][A-Za-z0-9.-]*)()"),
    ("settings", "host", r"(?m)^[ \t]*(?:export[ \t]+)?[A-Z][A-Z0-9_]*(?:HOST|URL|URI|ENDPOINT|SERVER)[ \t]*=[ \t]*[\"']?(?:[a-z+]+://)?(?:[^@ \t\n/]*@)?([A-Za-z0-9][A-Za-z0-9.-]*)()"),
]
APT = r"apt-get[ \t]+install[ \t]+((?:[ \t]*[a-z0-9.+=:-]+)+)"
# Infrastructure that a package speaks to, by the package's name or a name that contains it.
INFRASTRUCTURE = {
    "pg": "postgres", "postgres": "postgres", "postgresql": "postgres", "mysql": "mysql", "mysql2": "mysql", "mongodb": "mongodb", "mongoose": "mongodb", "redis": "redis", "ioredis": "redis", "kafkajs": "kafka", "kafka": "kafka",
    "amqplib": "rabbitmq", "aws-sdk": "aws", "@aws-sdk/client-s3": "s3", "boto3": "aws", "psycopg2": "postgres", "psycopg2-binary": "postgres", "asyncpg": "postgres", "sqlalchemy": "sql-datastore",
    "spring-boot-starter-data-jpa": "jpa-datastore", "spring-kafka": "kafka", "stackexchange.redis": "redis", "npgsql": "postgres",
}


def infrastructure(name: Column) -> Column:
    """What a package speaks to, by its name, else by the first listed name that it contains; '' if nothing is known."""
    low = F.lower(name)
    inside = F.filter(F.array(*map(F.lit, INFRASTRUCTURE)), lambda k: low.contains(k))
    return F.coalesce(I.lookup(INFRASTRUCTURE, low), I.lookup(INFRASTRUCTURE, F.coalesce(F.get(inside, F.lit(0)), F.lit("-"))), F.lit(""))


def dependencies(files: DataFrame) -> DataFrame:
    """(component, kind, source, name, version, infrastructure, n_files): packages, base images, images, ports, hosts and system
    libraries that manifests name. Of settings only hosts are read; values that may be secrets never come out."""
    kind = manifest_kind("relative_path")

    def named(wanted: str, source: str, pattern: str) -> Column:
        zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("version"))
        rows = F.transform(zipped, lambda x: F.struct(F.lit(source).alias("source"), x["name"].alias("name"), F.coalesce(x["version"], F.lit("")).alias("version")))
        return F.when(F.col("kind") == wanted, rows)

    lists = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(APT), F.lit(1)), lambda t: F.split(F.trim(t), "[ \t]+")))
    system = F.transform(F.filter(lists, lambda p: p.rlike("^[a-z0-9]")), lambda p: F.struct(F.lit("system").alias("source"), F.regexp_extract(p, "^[a-z0-9.+:-]+", 0).alias("name"), F.regexp_extract(p, "=(.*)$", 1).alias("version")))
    rows = F.flatten(F.array_compact(F.array(*(named(*f) for f in FORMS), F.when(F.col("kind").isin("docker", "shell"), system))))
    typed = files.where("text is not null").select("file_id", component("relative_path").alias("component"), kind.alias("kind"), "text")
    found = typed.select("file_id", "component", "kind", F.inline(F.array_distinct(rows)))
    return found.groupBy("component", "kind", "source", "name", "version").agg(F.count("*").alias("n_files")).withColumn("infrastructure", F.when(F.col("source") == "package", infrastructure(F.col("name"))).otherwise(""))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def named_components(files: DataFrame) -> DataFrame:
    """(assessment_id, directory, name): directories whose manifest gives its component a name."""
    name = (
        F.when(manifest_kind("relative_path") == "npm", F.regexp_extract("text", r'"name"\s*:\s*"([^"]+)"', 1)).when(manifest_kind("relative_path") == "maven", F.regexp_extract("text", r"<artifactId>\s*([^<\s]+)", 1))
        .when(manifest_kind("relative_path") == "csproj", F.regexp_replace(F.substring_index("relative_path", "/", -1), r"(?i)\.csproj$", ""))
    )
    return files.where("text is not null").select("assessment_id", _directory(F.col("relative_path")).alias("directory"), name.alias("name")).where("name <> ''").groupBy("assessment_id", "directory").agg(F.min("name").alias("name"))


def owners(files: DataFrame) -> DataFrame:
    """(file_id, owner, depth): the named component of the nearest directory above a file, else its first telling directory (depth -1)."""
    parts = F.split(_directory(F.col("relative_path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("directory")))
    places = files.where("relative_path is not null").select("file_id", "assessment_id", component("relative_path").alias("fallback"), F.inline(above))
    met = salted_join(places, named_components(files), ["assessment_id", "directory"], ["file_id"], "left")
    return met.groupBy("file_id").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("depth"))).alias("name"), F.max(F.when(F.col("name").isNotNull(), F.col("depth"))).alias("depth"), F.min("fallback").alias("fallback")).select(
        "file_id", F.coalesce("name", "fallback").alias("owner"), F.coalesce("depth", F.lit(-1)).alias("depth")
    )


def normalised_path(path: Column) -> Column:
    """A path without ``.`` and with ``..`` resolved; one that leaves the root is null."""
    step = lambda acc, p: F.when(acc.isNull() | p.isin("", "."), acc).when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def build_contexts(files: DataFrame) -> DataFrame:
    """(file_id, context, component): directories that a compose file builds, with the named component that lies there (null if none)."""
    stated = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*(?:build|context):[ \t]*[\"']?([A-Za-z0-9_./-]+)"), F.lit(1)))
    found = files.where((manifest_kind("relative_path") == "compose") & F.col("text").isNotNull()).select("file_id", "assessment_id", "relative_path", stated.alias("stated"))
    placed = found.withColumn("directory", normalised_path(F.concat_ws("/", F.nullif(_directory(F.col("relative_path")), F.lit("")), "stated")))
    return salted_join(placed, named_components(files), ["assessment_id", "directory"], ["file_id"], "left").select("file_id", F.col("stated").alias("context"), F.col("name").alias("component"))


def quotes_in_files(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(attribute, n, n_with_file, n_in_text): quotes that name a path before them, those whose path is a file of the assessment, and
    those whose words stand in it. A path meets its files by its hash parts; the longest text of a path counts."""
    path = F.regexp_extract("evidence_quote", r"^\[([^\]]+)\]\s*", 1)
    quoted = claims.dropDuplicates(["claim_id"]).where(path != "").select("claim_id", "assessment_id", F.translate(F.lower("attribute"), " -", "__").alias("attribute"), path.alias("path"), flattened(F.regexp_replace("evidence_quote", r"^\[[^\]]+\]\s*", "")).alias("quote"))
    texts = files.where("text is not null").groupBy("assessment_id", F.col("relative_path").alias("path")).agg(F.max_by("text", F.struct(F.length("text"), "file_id")).alias("text"))
    met = salted_join(quoted, texts, ["assessment_id", "path"], ["claim_id"], "left")
    return met.groupBy("attribute").agg(F.count("*").alias("n"), F.count("text").alias("n_with_file"), F.count_if(F.col("text").isNotNull() & flattened("text").contains(F.col("quote"))).alias("n_in_text"))
