"""Tables inside texts and delimited files: grids, header detection, shape checks, summaries, rows to claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estateloom.functions import inventory as I
from estateloom.functions.keys import host_slug

SUMMARY_FIELDS = ["vcpus", "memory_gb", "disk_gb", "cpu_utilization_pct"]


def strict_number(cell: Column) -> Column:
    """A whole cell that is a number, thousands commas and a percent sign aside."""
    return F.regexp_replace(F.regexp_replace(F.trim(cell), ",", ""), "%$", "").try_cast("double")


def pipe_tables(documents: DataFrame) -> DataFrame:
    """(doc_id, table_no, header, rows): runs of pipe lines whose second line is a rule; cells stripped."""
    runs = F.regexp_extract_all(F.concat(F.col("text"), F.lit("\n")), F.lit(r"((?:[ \t]*\|[^\n]*\n)++)"), F.lit(1))
    lines = F.transform(F.filter(F.split("run", "\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), r"^\||\|$", ""))
    cells = F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))
    t = documents.where("text like '%|%'").select("doc_id", F.posexplode(runs).alias("table_no", "run")).select("doc_id", "table_no", cells.alias("cells"))
    ruled = (F.size("cells") >= 2) & F.forall(F.get("cells", F.lit(1)), lambda c: c.rlike("^:?-+:?$"))
    return t.where(ruled).select("doc_id", "table_no", F.get("cells", F.lit(0)).alias("header"), F.slice("cells", F.lit(3), F.size("cells")).alias("rows"))


def table_shapes(tables: DataFrame) -> DataFrame:
    """(doc_id, table_no, n_rows, n_columns, n_ragged, regular): more than a tenth of rows of another width make a table irregular."""
    ragged = F.size(F.filter("rows", lambda r: F.size(r) != F.size("header")))
    n = F.size("rows")
    return tables.select("doc_id", "table_no", n.alias("n_rows"), F.size("header").alias("n_columns"), ragged.alias("n_ragged"), (ragged <= 0.1 * n).alias("regular"))


def table_cells(tables: DataFrame) -> DataFrame:
    """The grid unpivoted: (doc_id, table_no, row_no, server, raw_header, field, value) of non-blank cells; server is the row's host cell."""
    headers = tables.withColumn("fields", F.transform("header", lambda h: I.canonical_header(h)))
    rows = headers.select("doc_id", "table_no", "header", "fields", F.posexplode("rows").alias("row_no", "row"))
    server = F.get("row", F.array_position("fields", F.lit("server")).cast("int") - 1)
    cells = F.transform("row", lambda v, i: F.struct(F.get("header", i).alias("raw_header"), F.get("fields", i).alias("field"), v.alias("value")))
    return rows.select("doc_id", "table_no", "row_no", server.alias("server"), F.inline(cells)).where("value <> ''")


def table_summaries(tables: DataFrame) -> DataFrame:
    """Per table and numeric field: sum, mean to one decimal, least, greatest, numeric cells and rows."""
    cells = table_cells(tables).where(F.col("field").isin(*SUMMARY_FIELDS)).withColumn("x", strict_number(F.col("value"))).where("x is not null")
    n = tables.select("doc_id", "table_no", F.size("rows").alias("n_rows"))
    sums = cells.groupBy("doc_id", "table_no", "field").agg(
        F.sum("x").alias("total"), F.round(F.avg("x"), 1).alias("mean"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.count("*").alias("n_values")
    )
    return sums.join(n, ["doc_id", "table_no"])


def rows_to_claims(tables: DataFrame) -> DataFrame:
    """Wide rows to claims: a claim per supported cell of a row with a host; a bare capacity takes the unit of its header unless that is GB."""
    supported = [f for f in I.COLUMN_ALIASES if f != "server"]
    unit = I.header_unit("raw_header")
    stamped = F.when(F.col("field").isin("memory_gb", "disk_gb", "disk_throughput_mbps") & ~unit.isin("gb", "gib") & ~F.col("value").rlike("[a-zA-Z]"), F.concat_ws(" ", "value", unit)).otherwise(F.col("value"))
    cells = table_cells(tables).where(F.col("field").isin(*supported) & (F.coalesce("server", F.lit("")) != ""))
    return cells.select("doc_id", "table_no", "row_no", host_slug("server").alias("entity_key"), F.col("field").alias("attribute"), F.coalesce(stamped, "value").alias("value"))


def detected_headers(lines: DataFrame) -> DataFrame:
    """(file_id, header_line): the first of the leading ten lines that has two or more cells, hardly any number, and a row of its width below."""
    head = lines.where("line_no <= 11").groupBy("file_id", "line_no").agg(F.min_by("raw_line", "line_id").alias("raw"))
    separator = F.regexp_extract("raw", "[,;\t]", 0)
    cells = F.transform(F.split("raw", F.when(separator == "", F.lit(",")).otherwise(separator)), lambda c: F.trim(F.regexp_replace(c, '["\r﻿]', "")))
    grid = head.select("file_id", "line_no", cells.alias("cells")).withColumn("filled", F.filter("cells", lambda c: c != ""))
    numbers = F.size(F.filter("filled", lambda c: strict_number(c).isNotNull()))
    measured = grid.select("file_id", "line_no", F.size("cells").alias("width"), F.size("filled").alias("n_filled"), numbers.alias("n_numbers"))
    below = measured.select("file_id", (F.col("line_no") - 1).alias("line_no"), F.col("width").alias("next_width"), F.col("n_filled").alias("next_filled"))
    fits = "line_no <= 10 and n_filled >= 2 and n_numbers < 0.3 * n_filled and next_filled >= 2 and next_width = width"
    found = measured.join(below, ["file_id", "line_no"], "left").groupBy("file_id").agg(F.min(F.when(F.expr(fits), F.col("line_no"))).alias("header_line"))
    return found.select("file_id", F.coalesce("header_line", F.lit(1)).alias("header_line"))


def filled_headers(tables: DataFrame) -> DataFrame:
    """Header cells with blanks taken from the last label to the left: (doc_id, table_no, col_no, label)."""
    filled = F.transform("header", lambda h, i: F.coalesce(F.try_element_at(F.filter(F.slice("header", 1, i + 1), lambda x: x != ""), F.lit(-1)), F.lit("")))
    return tables.select("doc_id", "table_no", F.posexplode(filled).alias("col_no", "label"))


# How total rows start.
_TOTAL = r"(?i)^\s*((grand\s+)?(sub[\s-]?)?totals?\b.*|(sum|overall)\s*)$"


def cleaned_tables(tables: DataFrame) -> DataFrame:
    """Tables without total rows, repeated headers and trailing notes, and how many of each were left out."""
    norm = lambda row: F.transform(row, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""))
    first = lambda row: F.coalesce(F.get(F.filter(row, lambda c: c != ""), F.lit(0)), F.lit(""))
    repeated = lambda r: norm(r) == norm(F.col("header"))
    total = lambda r: ~repeated(r) & first(r).rlike(_TOTAL)
    note = lambda r: (F.size(F.filter(r, lambda c: c != "")) == 1) & (F.size(F.split(first(r), r"\s+")) >= 4) & strict_number(first(r)).isNull()
    kept = tables.withColumn("body", F.filter("rows", lambda r: ~repeated(r) & ~total(r)))
    last_record = F.coalesce(F.array_max(F.transform("body", lambda r, i: F.when(~note(r), i + 1).otherwise(0))), F.lit(0))
    trimmed = kept.withColumn("n_body", last_record)
    return trimmed.select(
        "doc_id", "table_no", "header", F.slice("body", 1, F.col("n_body")).alias("rows"), F.size(F.filter("rows", total)).alias("n_totals"), F.size(F.filter("rows", repeated)).alias("n_repeats"), (F.size("body") - F.col("n_body")).alias("n_notes")
    )


def row_groups(tables: DataFrame, most_rows: int = 20, budget: int = 600) -> DataFrame:
    """(doc_id, table_no, group_no, first_row, n_rows, tokens): rows in order, closed at ``most_rows`` or when the budget less the header is used up."""
    line = lambda row: F.greatest(F.lit(1), F.floor(F.length(F.array_join(row, " | ")) / 4)).cast("int")
    room = tables.withColumn("room", F.greatest(F.lit(budget) - line(F.col("header")), F.lit(budget // 4)))
    kind = "array<struct<n:int,t:int>>"

    def add(acc: Column, row: Column) -> Column:
        t, last = line(row), F.get(acc, F.size(acc) - 1)
        fits = (F.size(acc) > 0) & (last["n"] < most_rows) & (last["t"] + t <= F.col("room"))
        grown = F.struct((last["n"] + 1).alias("n"), (last["t"] + t).alias("t"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(F.lit(1).alias("n"), t.alias("t"))))).cast(kind)

    groups = room.withColumn("g", F.aggregate("rows", F.array().cast(kind), add))
    first = F.transform("g", lambda x, i: F.struct(i.cast("int").alias("group_no"), F.aggregate(F.slice("g", 1, i), F.lit(0), lambda a, y: a + y["n"]).alias("first_row"), x["n"].alias("n_rows"), x["t"].alias("tokens")))
    return groups.select("doc_id", "table_no", F.inline(first))


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, segment_no, kind, n_chars): tables and the prose around them in document order; blank prose is left out."""
    marked = F.regexp_replace(F.concat("text", F.lit("\n")), r"((?:(?<=\n)|^)(?:[ \t]*\|[^\n]*\n)++)", "\u0001T$1\u0001P")
    parts = F.transform(F.split(F.concat(F.lit("P"), marked), "\u0001"), lambda p: F.struct(F.when(F.left(p, F.lit(1)) == "T", "table").otherwise("prose").alias("kind"), F.trim(F.regexp_replace(F.substring(p, F.lit(2), F.length(p)), r"^\s+|\s+$", "")).alias("body")))
    kept = F.filter(parts, lambda p: p["body"] != "")
    rows = F.transform(kept, lambda p, i: F.struct(i.cast("int").alias("segment_no"), p["kind"].alias("kind"), F.length(p["body"]).alias("n_chars")))
    return documents.where("text is not null").select("doc_id", F.inline(rows))


def stacked_headers(tables: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, table_no, n_header_rows, header): label-only rows under the header joined to it while the row below them is more numeric.

    A sparse band above the labels is filled to the right and put before labels that occur twice.
    """
    numbers = lambda row: F.size(F.filter(row, lambda c: strict_number(c).isNotNull()))
    label_like = lambda row: (F.size(F.filter(row, lambda c: c != "")) >= 2) & (numbers(row) == 0)
    further = lambda k: label_like(F.get("rows", F.lit(k))) & (numbers(F.get("rows", F.lit(k + 1))) > numbers(F.get("rows", F.lit(k))))
    extra = F.lit(0)
    for k in range(most - 1):
        extra = F.when((extra == k) & F.coalesce(further(k), F.lit(False)), k + 1).otherwise(extra)
    t = tables.withColumn("extra", extra)
    filled = F.transform("header", lambda h, i: F.coalesce(F.try_element_at(F.filter(F.slice("header", 1, i + 1), lambda x: x != ""), F.lit(-1)), F.lit("")))
    leaf = F.transform("header", lambda h, i: F.coalesce(*(F.nullif(F.when(F.col("extra") > k, F.get(F.get("rows", F.lit(k)), i)), F.lit("")) for k in reversed(range(most - 1))), h))
    t = t.withColumn("band", filled).withColumn("leaf", leaf)
    joined = F.transform("leaf", lambda x, i: F.when((F.col("extra") > 0) & (F.size(F.filter("leaf", lambda y: y == x)) > 1) & (F.get("band", i) != x), F.concat_ws(" ", F.get("band", i), x)).otherwise(x))
    return t.select("doc_id", "table_no", (F.col("extra") + 1).alias("n_header_rows"), F.when(F.col("extra") > 0, joined).otherwise(F.col("band")).alias("header"))


def labelled_rows(tables: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, said): rows as ``name: value`` pairs where the cells match the header, blank cells left out, 280 characters at most."""
    rows = tables.select("doc_id", "table_no", "header", F.posexplode("rows").alias("row_no", "row")).where(F.size("row") == F.size("header"))
    pairs = F.filter(F.zip_with("header", "row", lambda h, v: F.when(v != "", F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull())
    return rows.select("doc_id", "table_no", "row_no", F.left(F.array_join(pairs, " · "), F.lit(280)).alias("said"))


def table_chunks(tables: DataFrame, most_rows: int = 20, budget: int = 600) -> DataFrame:
    """(doc_id, table_no, kind, part, n_rows): row groups of regular tables; an irregular table stays one piece for the prose chunker."""
    shapes = table_shapes(tables).select("doc_id", "table_no", "regular")
    t = tables.join(shapes, ["doc_id", "table_no"])
    groups = row_groups(t.where("regular"), most_rows, budget).select("doc_id", "table_no", F.lit("rows").alias("kind"), F.col("group_no").alias("part"), "n_rows")
    return groups.unionByName(t.where("not regular").select("doc_id", "table_no", F.lit("prose").alias("kind"), F.lit(0).alias("part"), F.size("rows").alias("n_rows")))
