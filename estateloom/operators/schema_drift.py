"""Schemas that drift between the files of a feed: tagged-union inference, changes, and one consistent table.

Each JSON cell is tagged with its kind (number, boolean, text; nested objects and arrays by path). Per file and column the
kinds are fused into a union that keeps every alternative; per pair of successive files the unions are compared. A vanished
and a new column are the same column under another name if they carry the same facts about the hosts found in both files,
up to notation and unit: values are brought to a canonical form and compared under a fixed set of unit factors. Conflicting
kinds are split into typed branches beside a canonical conversion, and alternatives that appear later are reported.

Payloads are parsed once, into a table in the shared folder. The unit of work is the (file, host) pair: a feed that holds a
third of all rows is spread over its hosts, file-level tables meet the rows in a broadcast of checked size or else a salted
join, and all statistics are map-side-combined aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estateloom.functions import typed_text as T
from estateloom.functions.keys import SAYS_NOTHING, strip
from estateloom.functions.skew import fitted_join
from estateloom.session import written

FILE = ["feed_id", "file_seq"]

#: least share of compared hosts on which two columns must agree to be one column renamed
MIN_AGREEMENT = 0.6

# Unit factors under which two numeric columns may agree.
FACTORS = [1.0, 1024.0, 1 / 1024, 1024.0**2, 1 / 1024**2, 1000.0, 1 / 1000, 100.0, 1 / 100, 60.0, 1 / 60]

# Names under which inventories keep the host, compared without case and punctuation.
HOST_NAMES = [
    "hostname", "host", "fqdn", "vm", "vmname", "device", "devicename", "server", "servername", "name", "node", "nodename",
    "machine", "machinename", "computer", "computername", "dnsname", "instance", "system",
]
_HOST = r"^[a-z][a-z0-9]*(-[a-z0-9]+){2,}(\.[a-z0-9-]+)*$"

# Canonical field of a column name, compared without case and punctuation.
FIELDS = {
    "cores": ["cores", "vcpu", "vcpus", "cpus", "cpucount", "numcpu", "procs", "corecount", "processors"],
    "memory": ["memory", "memorygb", "memgb", "rammb", "memmb", "ramgib", "ramgb", "ram", "arbeitsspeicher", "memorymb"],
    "disk": ["disk", "diskgb", "disktb", "storagegb", "provisionedmb", "diskmb", "storage"],
    "os": ["os", "osname", "operatingsystem", "guestos", "betriebssystem"],
    "environment": ["environment", "env", "stage"],
    "datacenter": ["datacenter", "site", "location"],
    "owner": ["owner", "ownerteam", "managedby"],
    "asset_tag": ["assettag", "invno"],
    "ip_address": ["ip", "ipaddress", "primaryip"],
    "rack": ["rack", "rackpos"],
    "power_kw": ["powerkw", "avgdraw"],
    "last_seen": ["lastseen", "discoveredon"],
    "is_patched": ["ispatched", "patched", "patchok"],
    "cpu_pct": ["cpupct", "cpuutilizationpct", "cpu", "cpup95"],
}


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _kind(v: Column) -> Column:
    kinds = lambda s: F.when(s == "STRING", "text").when(s == "VOID", F.lit(None)).when(s == "BOOLEAN", "boolean").when(s.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise("text")
    return T.let(F.schema_of_variant(v), kinds)


def tagged_rows(inventory: DataFrame) -> DataFrame:
    """(feed, file, row, union): the row's columns as a map of (kind, text); resent rows once; unreadable JSON as no columns."""
    rows = inventory.groupBy(*FILE, "row_no", F.when(F.col("row_no").isNull(), F.col("record_id")).alias("own")).agg(F.max_by(F.struct("payload"), F.coalesce("record_id", F.lit(0)))["payload"].alias("payload"))
    fields = lambda o: F.when(F.schema_of_variant(o).startswith("OBJECT"), o).cast("map<string,variant>")
    tagged = F.transform_values("fields", lambda _, v: F.struct(_kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")))
    parsed = rows.select(*FILE, "row_no", T.let(F.try_parse_json("payload"), fields).alias("fields"))
    return parsed.select(*FILE, "row_no", tagged.alias("union"))


def fused(rows: DataFrame) -> DataFrame:
    """(feed, file, column): how often each kind occurs, the type, and how much the column looks like the host's."""
    cell = rows.select(*FILE, F.explode("union").alias("column", "cell")).select(*FILE, "column", "cell.kind", F.when(F.col("cell.kind") == "text", F.lower(F.trim("cell.text"))).alias("text"))
    per = cell.groupBy(*FILE, "column").agg(
        F.count("kind").alias("n"), F.count_if(F.col("kind") == "number").alias("n_number"), F.count_if(F.col("kind") == "boolean").alias("n_boolean"),
        F.count_if(F.col("kind") == "text").alias("n_text"), F.count_if(F.col("text").rlike(_HOST)).alias("n_host"), F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"),
    )
    kind = F.when(F.col("n") == 0, F.lit(None)).when(F.col("n_number") == F.col("n"), "number").when(F.col("n_boolean") == F.col("n"), "boolean").otherwise("text")
    n = F.greatest(F.col("n"), F.lit(1))
    varies = F.coalesce(F.col("low") != F.col("high"), F.lit(False)).cast("int")  # a file of one host has no varying column at all
    score = F.col("n_host") / n * 2 + varies + _bare(F.col("column")).isin(*HOST_NAMES).cast("int") * 2
    return per.withColumn("type", kind).withColumn("host_score", score).drop("low", "high")


def _files(columns: DataFrame) -> DataFrame:
    return columns.groupBy(*FILE).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "type"))).alias("types"), F.max_by("column", F.struct("host_score", "column")).alias("host_column")
    )


def transitions(rows: DataFrame, over_gaps: bool = False) -> DataFrame:
    """One row per pair of successive files: column types on both sides, vanished and new columns, host columns.

    Successive files are those numbered ``file_seq`` - 1 and ``file_seq``; with ``over_gaps`` a file follows the last one before
    it that exists, for feeds that lose files (one row per file is ordered then).
    """
    files = written(_files(fused(rows)))  # read on both sides of the step
    before = F.lag("file_seq").over(Window.partitionBy("feed_id").orderBy("file_seq")) if over_gaps else F.col("file_seq") - 1
    old = files.select("feed_id", F.col("file_seq").alias("old_seq"), F.col("types").alias("old_types"), F.col("host_column").alias("old_host"))
    return files.withColumn("old_seq", before).join(old, ["feed_id", "old_seq"]).select(
        *FILE, "old_seq", "old_types", F.col("types").alias("new_types"), "old_host", F.col("host_column").alias("new_host"),
        F.array_except(F.map_keys("old_types"), F.map_keys("types")).alias("gone"), F.array_except(F.map_keys("types"), F.map_keys("old_types")).alias("new"),
    )


def host_key(text: Column) -> Column:
    h = F.lower(strip(text))
    return F.when(h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), h).otherwise(F.substring_index(h, ".", 1))


def _number(text: Column) -> Column:
    """The number that a cell denotes in any notation: plain, with a unit behind it, decimal comma, truth values as 1 and 0."""
    return F.coalesce(T.quantity(text, r"[a-z%/]+\.?")["n"], T.boolean(text).cast("int").cast("double"))


def _canonical_text(text: Column) -> Column:
    t = F.lower(strip(text))
    return F.coalesce(T.date(text).cast("string"), F.when(t.rlike(_HOST), F.substring_index(t, ".", 1)).otherwise(F.regexp_replace(t, r"[\s_-]+", " ")))


def renamed_pairs(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """(feed, file, old, new): the one-to-one pairs of vanished and new columns that carry the same facts.

    Every row is read once: its file may be the old side of one step and the new side of another.
    """
    wanted = lambda step, column, flag: F.when(F.col("is_old") == flag, F.struct(F.col(step).alias("step"), F.col(column).alias("columns")))
    both_sides = steps.where((F.size("gone") > 0) & (F.size("new") > 0)).select("feed_id", F.col("file_seq").alias("step"), "old_seq", "old_host", "new_host", "gone", "new")
    sides = F.inline(F.array(F.struct(F.lit(True).alias("is_old"), F.col("old_seq").alias("file_seq"), F.col("old_host").alias("host_column")), F.struct(F.lit(False).alias("is_old"), F.col("step").alias("file_seq"), F.col("new_host").alias("host_column"))))
    lookups = both_sides.select("feed_id", "step", "gone", "new", sides).groupBy(*FILE).agg(
        F.max("host_column").alias("host_column"), F.max(wanted("step", "gone", True)).alias("as_old"), F.max(wanted("step", "new", False)).alias("as_new")
    )
    joined = fitted_join(rows, written(lookups), FILE, ["row_no"], "inner")

    def side(name: str, old: bool) -> Column:
        cells = F.filter(F.map_entries("union"), lambda e: F.array_contains(F.col(f"{name}.columns"), e["key"]) & e["value"]["text"].isNotNull() & ~F.lower(strip(e["value"]["text"])).isin("", *SAYS_NOTHING))
        made = F.transform(cells, lambda e: F.struct(F.col(f"{name}.step").alias("step"), F.lit(old).alias("is_old"), e["key"].alias("column"), e["value"]["text"].alias("text")))
        return F.when(F.col(name).isNotNull(), made).otherwise(F.array().cast("array<struct<step:int,is_old:boolean,column:string,text:string>>"))

    host = host_key(F.element_at("union", F.col("host_column"))["text"])
    cells = joined.select("feed_id", host.alias("host"), F.inline(F.concat(side("as_old", True), side("as_new", False)))).where("host <> ''")
    said = F.struct(_number(F.col("text")).alias("number"), F.xxhash64(_canonical_text(F.col("text"))).alias("said"))
    facts = cells.groupBy("feed_id", "step", "host", "is_old", "column").agg(F.min(said).alias("fact"))
    hosts = facts.groupBy("feed_id", "step", "host").agg(F.collect_list(F.struct("is_old", "column", "fact")).alias("facts"))  # one entry per column of the step
    olds, news = F.filter("facts", lambda x: x["is_old"]), F.filter("facts", lambda x: ~x["is_old"])
    met = F.flatten(F.transform(olds, lambda o: F.transform(news, lambda n: F.struct(o["column"].alias("old"), n["column"].alias("new"), o["fact"].alias("o"), n["fact"].alias("n")))))
    both = hosts.select("feed_id", F.col("step").alias("file_seq"), F.inline(met))
    a, b = F.col("o.number"), F.col("n.number")
    # a column keeps one unit, so agreement is counted for each factor by itself; rounding of the source is allowed for
    agree = [F.count_if(F.coalesce(F.abs(b - a * f) <= F.greatest(F.abs(b), F.abs(a * f)) * 0.002, F.col("o.said") == F.col("n.said"))) for f in FACTORS]
    pairs = both.groupBy(*FILE, "old", "new").agg(F.count("*").alias("n"), F.greatest(*agree).alias("same")).where(F.col("same") >= F.greatest(F.lit(1), F.col("n") * MIN_AGREEMENT))
    rank = [(F.col("same") / F.col("n")).desc(), F.col("same").desc(), F.levenshtein(F.lower("old"), F.lower("new")), F.col("old"), F.col("new")]
    best = pairs.withColumn("r_old", F.row_number().over(Window.partitionBy(*FILE, "old").orderBy(*rank))).withColumn("r_new", F.row_number().over(Window.partitionBy(*FILE, "new").orderBy(*rank)))
    return best.where("r_old = 1 and r_new = 1").select(*FILE, "old", "new")


def changes(inventory: DataFrame, over_gaps: bool = False) -> DataFrame:
    """(feed_id, file_seq, change_kind, old_column, new_column) from each file to the next of its feed.

    Edge cases: an empty table gives none; a file whose predecessor is missing has no changes (with ``over_gaps`` those since the last file before it); a column that is null
    throughout a file has no type there and is not retyped; rows whose payload is null or no JSON object have no columns;
    resent rows count once, rows without a ``row_no`` are rows of their own, those of a null feed or file have no changes; rows without a host are not compared; further columns of the input are ignored.
    """
    rows = written(tagged_rows(inventory))
    steps = written(transitions(rows, over_gaps))
    pairs = written(renamed_pairs(rows, steps))

    def change(df: DataFrame, kind: str, old: Column, new: Column) -> DataFrame:
        return df.select(*FILE, F.lit(kind).alias("change_kind"), old.alias("old_column"), new.alias("new_column"))

    none = F.lit("")
    gone = steps.select(*FILE, F.explode("gone").alias("old")).join(pairs, [*FILE, "old"], "left_anti")
    new = steps.select(*FILE, F.explode("new").alias("new")).join(pairs, [*FILE, "new"], "left_anti")
    kept = steps.select(*FILE, "old_types", "new_types", F.explode(F.array_intersect(F.map_keys("old_types"), F.map_keys("new_types"))).alias("old")).withColumn("new", F.col("old"))
    both = kept.unionByName(pairs.join(steps.select(*FILE, "old_types", "new_types"), FILE))
    retyped = both.where(F.element_at("old_types", F.col("old")) != F.element_at("new_types", F.col("new")))
    return (
        change(pairs, "renamed", F.col("old"), F.col("new"))
        .unionByName(change(gone, "removed", F.col("old"), none))
        .unionByName(change(new, "added", none, F.col("new")))
        .unionByName(change(retyped, "retyped", F.col("old"), F.col("new")))
    )


def _path_kind(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), "object").when(F.schema_of_variant(v).startswith("ARRAY"), "array").otherwise(_kind(v))


def tagged_paths(inventory: DataFrame) -> DataFrame:
    """(feed, file, path, kind, n): how often each kind occurs at each path; ``a.b`` is a member of an object, ``a[]`` an element of an array.

    Level by level: only objects and arrays are opened further, until none is left.
    """
    rows = inventory.groupBy(*FILE, "row_no", F.when(F.col("row_no").isNull(), F.col("record_id")).alias("own")).agg(F.max_by(F.struct("payload"), F.coalesce("record_id", F.lit(0)))["payload"].alias("payload"))
    columns = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")).cast("map<string,variant>")
    level = rows.select(*FILE, F.try_parse_json("payload").alias("v")).select(*FILE, F.explode(columns).alias("path", "v"))
    counted = []
    while True:
        level = written(level.select(*FILE, "path", "v", _path_kind(F.col("v")).alias("kind")).where("kind is not null"))
        counted.append(level.groupBy(*FILE, "path", "kind").agg(F.count("*").alias("n")))
        nested = level.where("kind in ('object', 'array')")
        if nested.isEmpty():
            break
        members = nested.lateralJoin(inventory.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("at", "name", "value"))
        level = members.select(*FILE, F.when(F.col("kind") == "array", F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", "path", "name")).alias("path"), F.col("value").alias("v"))
    kinds = counted[0]
    for k in counted[1:]:
        kinds = kinds.unionByName(k)
    return kinds


def type_branches(inventory: DataFrame) -> DataFrame:
    """The alternatives of each path of a feed: kind, first and last file with it, rows, and whether it appeared after the path's first file."""
    first = F.min("file_seq").over(Window.partitionBy("feed_id", "column"))
    return (
        tagged_paths(inventory).select("feed_id", F.col("path").alias("column"), "file_seq", "kind", "n")
        .groupBy("feed_id", "column", "kind").agg(F.min("file_seq").alias("file_seq"), F.max("file_seq").alias("last_seq"), F.sum("n").alias("n_rows"))
        .select("feed_id", "column", "kind", F.col("file_seq").alias("first_seq"), "last_seq", "n_rows", (F.col("file_seq") > first).alias("appeared_later"))
    )


def _field(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "%", "pct"), "[^a-z0-9]", "")
    bare = F.when(bare.startswith("cpup95"), "cpup95").otherwise(bare)
    field = F.lit(None).cast("string")
    for f, names in FIELDS.items():
        field = F.when(bare.isin(*names), F.lit(f)).otherwise(field)
    return field


def lineage(pairs: DataFrame) -> DataFrame:
    """(feed_id, column, linked): the field of each column of unknown name that renames of its feed link to a known one, over any
    number of renames; the nearest known name decides, among equally near ones the first."""
    both = pairs.select("feed_id", F.inline(F.array(F.struct(F.col("old").alias("column"), F.col("new").alias("other")), F.struct(F.col("new").alias("column"), F.col("old").alias("other"))))).distinct()
    links = written(both.select("feed_id", "column", "other", _field(F.col("column")).alias("own")))
    known = written(links.where("own is not null").select("feed_id", "column", F.col("own").alias("linked")).distinct())
    while True:
        open_ = links.where("own is null").join(known.select("feed_id", "column"), ["feed_id", "column"], "left_anti")
        reached = written(open_.join(known.withColumnRenamed("column", "other"), ["feed_id", "other"]).groupBy("feed_id", "column").agg(F.min("linked").alias("linked")))
        if reached.isEmpty():
            return known
        known = written(known.unionByName(reached))


def consistent_table(inventory: DataFrame) -> DataFrame:
    """All files of all feeds as one table: canonical columns, and the typed branches of every field beside them.

    A column's field is known by its name or, where the name is unknown, by the nearest known name that renames of the same
    feed link it to (``lineage``); other columns stay under their own name in the branch maps. Capacities are in GB: the unit in the
    cell counts, else the one in the column's name, else GB. Cells that a canonical type cannot hold are null there and
    remain in ``text_branch``. Rows without a host keep a null ``host``.
    """
    rows = written(tagged_rows(inventory))
    pairs = renamed_pairs(rows, written(transitions(rows)))
    columns = fused(rows).join(lineage(pairs), ["feed_id", "column"], "left")
    named = columns.select(*FILE, "column", "host_score", F.coalesce(_field(F.col("column")), "linked", "column").alias("field"))
    files = named.groupBy(*FILE).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "field"))).alias("fields"), F.max_by("column", F.struct("host_score", "column")).alias("host_column")
    )
    joined = fitted_join(rows, written(files), FILE, ["row_no"], "left")
    host = F.element_at("union", F.col("host_column"))["text"]
    entries = F.transform(
        F.filter(F.map_entries("union"), lambda e: (e["key"] != F.col("host_column")) & e["value"]["kind"].isNotNull()),
        lambda e: F.struct(F.element_at("fields", e["key"]).alias("field"), e["key"].alias("column"), e["value"]["kind"].alias("kind"), e["value"]["text"].alias("text")),
    )
    flat = joined.select(*FILE, "row_no", host_key(host).alias("host"), F.array_sort(entries).alias("cells"))

    def branch(kind: str, type_: str) -> Column:
        own = F.filter("cells", lambda c: c["kind"] == kind)
        return F.map_from_entries(F.transform(own, lambda c: F.struct(c["column"].alias("key"), c["text"].try_cast(type_).alias("value"))))

    cell = lambda field: F.try_element_at(F.filter("cells", lambda c: c["field"] == field), F.lit(1))

    def capacity(field: str) -> Column:
        text, unit = cell(field)["text"], F.regexp_extract(F.lower(cell(field)["column"]), "(mb|tb|kb|mib|tib|kib)", 1)
        return T.gigabytes(F.when(strip(text).rlike(r"[0-9]$"), F.concat(text, F.lit(" "), unit)).otherwise(text))

    says = lambda field: F.when(~F.lower(strip(cell(field)["text"])).isin("", *SAYS_NOTHING), strip(cell(field)["text"]))
    return flat.select(
        *FILE, "row_no", "host", T.whole_number(cell("cores")["text"], "vcpus?|cores?|cpus?|c").alias("cores"), capacity("memory").alias("memory_gb"), capacity("disk").alias("disk_gb"),
        *(says(f).alias(f) for f in ("os", "environment", "datacenter", "owner", "asset_tag", "ip_address", "rack")), _number(cell("power_kw")["text"]).alias("power_kw"),
        T.date(cell("last_seen")["text"]).alias("last_seen"), T.boolean(cell("is_patched")["text"]).alias("is_patched"), T.percent(cell("cpu_pct")["text"]).alias("cpu_pct"),
        branch("number", "double").alias("number_branch"), branch("boolean", "boolean").alias("boolean_branch"), branch("text", "string").alias("text_branch"),
    )
