"""Names, units and plausibility of inventory fields, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estateloom.functions.keys import col, host_slug, slug
from estateloom.functions.typed_text import let

# Header spellings, in snake case, of each inventory field.
COLUMN_ALIASES = {
    "server": [
        "server", "hostname", "host", "host_name", "server_name", "vm", "vm_name", "instance", "instance_id", "instance_name", "machine",
        "machine_name", "computer_name", "node", "node_name", "device", "device_name", "fqdn", "name",
    ],
    "vcpus": ["vcpus", "vcpu", "cpu_cores", "cores", "cpu", "cpu_count", "processors", "num_cpus"],
    "memory_gb": ["memory_gb", "memory", "ram_gb", "ram", "mem", "mem_gb", "memory_mb", "ram_mb"],
    "cpu_utilization_pct": ["cpu_utilization_pct", "cpu_utilization", "avg_cpu_pct", "cpu_pct", "cpu_usage", "cpu_usage_pct"],
    "memory_utilization_pct": ["memory_utilization_pct", "memory_utilization", "avg_memory_pct", "memory_pct", "mem_utilization", "memory_usage_pct"],
    "disk_gb": ["disk_gb", "storage_gb", "disk_capacity_gb", "storage", "disk", "disk_size", "disk_size_gb", "capacity_gb"],
    "disk_iops": ["disk_iops", "iops", "provisioned_iops"],
    "disk_throughput_mbps": ["disk_throughput_mbps", "throughput_mbps", "disk_throughput", "throughput"],
    "os": ["os", "operating_system", "os_name", "platform", "os_version"],
    "environment": ["environment", "env", "stage", "tier_env"],
    "region": ["region", "location", "datacenter", "data_center", "az", "availability_zone"],
    "architecture": ["architecture", "arch", "cpu_architecture", "isa"],
}
# Fields that hold a measurement, and their plausible ranges.
BOUNDS = {
    "vcpus": (1.0, 1024.0),
    "memory_gb": (0.5, 24576.0),
    "cpu_utilization_pct": (0.0, 100.0),
    "memory_utilization_pct": (0.0, 100.0),
    "disk_gb": (1.0, 1048576.0),
    "disk_iops": (1.0, 20000000.0),
    "disk_throughput_mbps": (1.0, 100000.0),
}
# Factors of capacity units to GB.
TO_GB = {"b": 1 / 1024**3, "kb": 1 / 1024**2, "kib": 1 / 1024**2, "mb": 1 / 1024, "mib": 1 / 1024, "gb": 1.0, "gib": 1.0, "tb": 1024.0, "tib": 1024.0, "pb": 1048576.0, "pib": 1048576.0}
# Attribute names that mean an entity's name, and synonyms of other attributes.
NAME_ATTRIBUTES = ["name", "display_name", "hostname", "host_name", "server_name", "app_name", "application_name", "database_name", "db_name", "service_name", "title"]
ATTRIBUTE_SYNONYMS = {
    "criticality": "business_criticality", "business_criticality": "business_criticality", "db_engine": "engine", "database_engine": "engine", "engine_type": "engine", "dbms": "engine",
    "app_tier": "tier", "business_owner": "owner", "team": "owner",
}
# Keys that name no entity.
GENERIC_KEYS = [
    "unknown", "none", "null", "n-a", "na", "not-applicable", "tbd", "tba", "not-specified", "not-documented", "not-available", "other", "misc",
    "various", "multiple", "application", "applications", "the-application", "the-app", "service", "services", "the-service", "system", "systems", "the-system", "server", "servers", "the-server", "database", "databases", "the-database", "interface", "interfaces", "integration", "integrations",
    "platform", "the-platform",
]
# Spellings of the entity types.
TYPE_SYNONYMS = {
    "application": [
        "application", "applications", "app", "apps", "service", "services", "microservice", "system", "web-app", "webapp", "component", "workload",
        "business-application",
    ],
    "server": ["server", "servers", "host", "hosts", "vm", "vms", "virtual-machine", "instance", "node", "machine", "compute", "hostname"],
    "database": ["database", "databases", "db", "dbs", "datastore", "data-store", "schema"],
    "interface": ["interface", "interfaces", "integration", "endpoint", "api", "api-endpoint", "queue", "topic", "message-queue", "feed"],
    "business": ["business", "requirement", "requirements", "nfr", "non-functional-requirement", "compliance", "constraint"],
}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def inverted(table: dict[str, list[str]]) -> dict[str, str]:
    return {alias: name for name, aliases in table.items() for alias in aliases}


def snake(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def canonical_header(c: Column | str) -> Column:
    """The field that a column header names, or the header in snake case."""
    return let(snake(c), lambda k: F.coalesce(lookup(inverted(COLUMN_ALIASES), k), k))


def header_unit(c: Column | str) -> Column:
    """The capacity unit in a header, null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(col(c)), r"\b(mb|mib|gb|gib|tb|tib|kb|pb|pib)\b", 1), F.lit(""))


def canonical_entity_type(c: Column | str) -> Column:
    return lookup(inverted(TYPE_SYNONYMS), slug(c))


def canonical_entity_key(entity_type: Column, key: Column) -> Column:
    """Servers by short host name, others as a slug without a leading article."""
    plain = let(slug(key), lambda k: F.when(k.startswith("the-") & (F.length(k) > 4), F.substring(k, 5, 1000)).otherwise(k))
    return F.when(entity_type == "server", host_slug(key)).otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown")))


def is_generic_key(entity_type: Column, key: Column) -> Column:
    return (entity_type != "business") & (F.coalesce(key, F.lit("")).isin("", *GENERIC_KEYS))


def canonical_attribute(c: Column | str) -> Column:
    fields = {a: f for a, f in inverted(COLUMN_ALIASES).items() if f != "server"}
    table = {**fields, **ATTRIBUTE_SYNONYMS, **dict.fromkeys(NAME_ATTRIBUTES, "name")}
    return let(snake(c), lambda k: F.coalesce(lookup(table, k), F.nullif(k, F.lit("")), F.lit("unknown")))


def to_canonical(field: Column, raw: Column) -> Column:
    """The first number in ``raw`` in the unit of ``field``: capacities in GB by the unit behind it, shares without % as percent."""
    number = r"-?\d+(?:\.\d+)?"

    def convert(t: Column) -> Column:
        n = F.regexp_extract(t, number, 0).try_cast("double")
        unit = F.regexp_extract(F.trim(F.regexp_extract(t, rf"(?s)^.*?{number}(.*)$", 1)), "^[a-zµ/%]+", 0)
        return (
            F.when(field.isin("memory_gb", "disk_gb"), n * F.coalesce(lookup({k: str(v) for k, v in TO_GB.items()}, unit).cast("double"), F.lit(1.0)))
            .when((field == "disk_throughput_mbps") & unit.rlike("^(gb|gib|g/)"), n * 1024.0)
            .when(field.endswith("_pct") & ~t.contains("%") & (n > 0) & (n < 1), n * 100.0)
            .otherwise(n)
        )

    return let(F.regexp_replace(F.lower(F.trim(raw)), ",", ""), convert)


def is_plausible(field: Column, value: Column) -> Column:
    low = lookup({k: str(a) for k, (a, _) in BOUNDS.items()}, field).cast("double")
    high = lookup({k: str(b) for k, (_, b) in BOUNDS.items()}, field).cast("double")
    return F.coalesce((value >= low) & (value <= high), F.lit(True))


def comparison_value(field: Column, raw: Column) -> Column:
    """What two claims are compared by: measured fields by their number to six digits, others by stripped lower-case text."""
    measured = F.when(field.isin(*BOUNDS), to_canonical(field, raw))
    return F.coalesce(let(measured, lambda x: F.when(x.isNotNull(), F.format_string("%.5e", F.round(x, 3) + 0.0))), F.lower(F.trim(raw)))
