"""Keys, blanks and words that say nothing, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries that say nothing, compared stripped and in lower case.
SAYS_NOTHING = ["n/a", "tbd", "unknown", "-", "?"]

_IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without outer white space of any script."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(strip(c), F.lit("")) == ""


def says_something(c: Column | str) -> Column:
    return ~F.coalesce(F.lower(strip(c)), F.lit("")).isin("", *SAYS_NOTHING)


def entity_key(entity_type: Column | str, key: Column | str) -> Column:
    """Lower case without outer blanks; servers lose what follows the first dot unless the key is an IPv4 address."""
    k = F.lower(strip(key))
    return F.when((col(entity_type) == "server") & ~k.rlike(_IPV4), F.substring_index(k, ".", 1)).otherwise(k)


def attribute_key(attribute: Column | str) -> Column:
    """Lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(col(attribute)), " -", "__")


def slug(c: Column | str) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def host_slug(c: Column | str) -> Column:
    """Short host name of a dotted name whose last label is alphabetic; addresses stay whole; empty gives ``unknown``."""
    t = F.lower(F.trim(col(c)))
    short = F.when(t.rlike(r"^[a-z0-9][a-z0-9-]*(\.[a-z0-9-]+)*\.[a-z]+$"), F.substring_index(t, ".", 1)).when(t.rlike(_IPV4), t).otherwise(slug(t))
    return F.when(F.coalesce(short, F.lit("")) == "", F.lit("unknown")).otherwise(short)
