"""Delimited records that fail to parse: an error-recovering recursive-descent grammar.

    file   := record (EOL record)*        record := field (SEP field)*
    field  := quoted | bare               quoted := '"' ([^"] | '""')* '"'         bare := [^" SEP EOL]*

A syntax error is located (offset, rule, message) and recorded; parsing resumes at the next *validated record-start
anchor*: a line start after the error from which one whole record of the header's width can be derived. Records derived
after an anchor come out beside the error, typed and judged as any other record, and those that hold load, so a broken
quote that swallowed its neighbours loses none of them.

Spark partitions the work: each line meets its file's header in a salted join (one file may hold any share of the rows),
and the grammar is a helper run over Arrow batches of lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estateloom.functions.skew import salted_join

SEPARATORS = ",;\t"
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
#: whole number from 1 to 1024 in digits 0-9, leading zeros and a fraction of only zeros allowed
_VCPU = re.compile(r"0*([1-9][0-9]{0,3})(?:\.0+)?")


class SyntaxFault(Exception):
    def __init__(self, offset: int, rule: str, message: str, resume: int):
        super().__init__(message)
        self.offset, self.rule, self.message = offset, rule, message
        self.resume = resume  # where the broken field starts: anchors are looked for from there


class RecordGrammar:
    """The grammar above for one separator; ``whole=True`` reads the text as one record, line feeds included."""

    def __init__(self, separator: str):
        self.sep = separator
        self._bare = {whole: re.compile(f'[^"{separator}{"" if whole else chr(92) + "n"}]*') for whole in (True, False)}

    def field(self, text: str, at: int, whole: bool) -> tuple[str, int]:
        if text.startswith('"', at):
            m = _QUOTED.match(text, at)
            if not m:
                raise SyntaxFault(at, "quoted", "quoted field is never closed", at)
            value, end = m.group(1).replace('""', '"'), m.end()
            if end < len(text) and text[end] != self.sep and (whole or text[end] != "\n") and text[end:] != "\r" and text[end : end + 2] != "\r\n":
                raise SyntaxFault(end, "quoted", "text after the closing quote", at)
            return value, end
        m = self._bare[whole].match(text, at)
        if m.end() < len(text) and text[m.end()] == '"':
            raise SyntaxFault(m.end(), "bare", "quote inside an unquoted field", at)
        return m.group(), m.end()

    def record(self, text: str, at: int = 0, whole: bool = False, starts: list[int] | None = None) -> tuple[list[str], int]:
        """Fields of the record that starts at ``at``, and where it ends; ``starts`` gets where each field does."""
        fields = []
        while True:
            if starts is not None:
                starts.append(at)
            value, at = self.field(text, at, whole)
            fields.append(value)
            if at < len(text) and text[at] == self.sep:
                at += 1
                continue
            return fields, at

    def recover(self, text: str, at: int, width: int) -> list[tuple[int, list[str]]]:
        """(offset, fields) of records from the first validated anchor after ``at`` on; each further error looks for its own anchor."""
        found, at = [], text.find("\n", at)
        while at != -1:
            try:
                fields, end = self.record(text, at + 1)
                if len(fields) == width and fields[0].strip() and (end >= len(text) or text[end] == "\n"):
                    found.append((at + 1, [f.removesuffix("\r") for f in fields]))
                    at = end if end < len(text) else -1
                    continue
            except SyntaxFault:
                pass
            at = text.find("\n", at + 1)
        return found


def strip_line_ending(text: str) -> str:
    return text.removesuffix("\n").removesuffix("\r")


@lru_cache(maxsize=4096)
def read_header(raw: str | None) -> tuple[str, tuple[str, ...]]:
    """(separator, column names) of a header line; the separator is the one that gives most columns."""
    text = strip_line_ending((raw or "").removeprefix("﻿"))
    best: tuple[str, tuple[str, ...]] = (",", (text,))
    for sep in SEPARATORS:
        try:
            names, _ = RecordGrammar(sep).record(text, 0, True)
        except SyntaxFault:
            continue
        if len(names) > len(best[1]):
            best = (sep, tuple(n.strip() for n in names))
    return best


@lru_cache(maxsize=8)
def _grammar(sep: str) -> RecordGrammar:
    return RecordGrammar(sep)


def vcpu_value(text: str) -> int | None:
    m = _VCPU.fullmatch(text)
    return int(m.group(1)) if m and int(m.group(1)) <= 1024 else None


def _typed(fields: list[str], names: tuple[str, ...]) -> tuple[int | None, str | None]:
    """(vcpu, fault) of a record of the header's width."""
    if "vcpu" not in names:
        return None, None
    cell = fields[names.index("vcpu")].strip()
    vcpu = vcpu_value(cell) if cell else None
    return vcpu, f"vcpu: {cell[:80]!r} is no whole number from 1 to 1024" if cell and vcpu is None else None


def parse_line(raw: str | None, header: str | None) -> tuple[str | None, int, str, list[str] | None, list[tuple[int, list[str], int | None, str | None]], int | None]:
    """(reason, offset, detail, fields, recovered records, vcpu) of one record; reason is null if it loads.

    Recovered records are (offset, fields, vcpu, detail); the detail is null if they load. The offset of a ``value`` fault is that of its cell.
    """
    sep, names = read_header(header)
    text, g = strip_line_ending(raw or ""), _grammar(sep)
    starts: list[int] = []
    try:
        fields, _ = g.record(text, 0, True, starts)
    except SyntaxFault as fault:
        recovered = [(at, cells, *_typed(cells, names)) for at, cells in g.recover(text, fault.resume, len(names))]
        return "quoting", fault.offset, f"{fault.rule}: {fault.message}", None, recovered, None
    if len(fields) != len(names):
        return "columns", len(text), f"{len(fields)} fields, the header has {len(names)}", fields, [], None
    vcpu, fault = _typed(fields, names)
    if fault:
        return "value", starts[names.index("vcpu")], fault, fields, [], None
    return None, 0, "", fields, [], vcpu


_CELLS = pa.map_(pa.string(), pa.string())
_RECOVERED = pa.struct([("error_offset", pa.int32()), ("cells", _CELLS), ("vcpu", pa.int32()), ("detail", pa.string())])
_OUT = pa.schema(
    [
        ("line_id", pa.int64()), ("assessment_id", pa.string()), ("file_id", pa.string()), ("file_kind", pa.string()), ("line_no", pa.int32()),
        ("received_at", pa.timestamp("us", "UTC")), ("reason", pa.string()), ("error_offset", pa.int32()), ("detail", pa.string()),
        ("cells", _CELLS), ("recovered", pa.list_(_RECOVERED)), ("vcpu", pa.int32()),
    ]
)
_DDL = (
    "line_id bigint, assessment_id string, file_id string, file_kind string, line_no int, received_at timestamp, reason string, "
    "error_offset int, detail string, cells map<string,string>, "
    "recovered array<struct<error_offset:int,cells:map<string,string>,vcpu:int,detail:string>>, vcpu int"
)
_KEEP = ["line_id", "assessment_id", "file_id", "file_kind", "line_no", "received_at"]


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        results = []
        for raw, header in zip(batch.column("raw_line").to_pylist(), batch.column("header").to_pylist(), strict=True):
            reason, offset, detail, fields, recovered, vcpu = parse_line(raw, header)
            cells = lambda values: list(dict(zip(read_header(header)[1], values, strict=False)).items())  # noqa: E731, B023
            behind = [{"error_offset": at, "cells": cells(f), "vcpu": v, "detail": d} for at, f, v, d in recovered]
            results.append((reason, offset, detail, None if fields is None else cells(fields), behind, vcpu))
        made = [list(x) for x in zip(*results, strict=True)] if results else [[]] * 6
        kept = [batch.column(c).cast(_OUT.field(c).type) for c in _KEEP]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, f.type) for v, f in zip(made, list(_OUT)[len(_KEEP) :], strict=True))], schema=_OUT)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every line after the header of ``inventory_lines``, parsed: ``reason`` is null for rows that load.

    Edge cases: a null or empty ``raw_line`` is a record of one empty field; a file without a header line counts as
    one comma-separated unnamed column, so its lines fail with ``columns`` unless they have one field; of
    several header lines the one with the lowest ``line_id`` counts; a null ``file_id`` has no header, a null ``line_no`` makes no data line. Further columns of
    the input are ignored, repeated rows come out as often as they go in, an empty table gives an empty table.
    """
    body = lines.where("line_no > 1").select(*_KEEP, "raw_line")
    header = lines.where("line_no = 1").groupBy("file_id").agg(F.min_by("raw_line", "line_id").alias("header"))
    joined = salted_join(body, header, ["file_id"], ["line_id"], "left")
    return joined.select(*_KEEP, "raw_line", "header").mapInArrow(_parse_batches, _DDL)


def rejected(parsed: DataFrame) -> DataFrame:
    """Lines that do not load: where, why, and the records recovered behind the error."""
    return parsed.where("reason is not null").select("line_id", "file_id", "line_no", "reason", "error_offset", "detail", F.to_json("recovered").alias("recovered"))


def loaded(parsed: DataFrame) -> DataFrame:
    """Typed inventory rows; cells other than ``vcpu`` never reject a line, so they are null where they cannot be typed.

    ``part`` is 0 for a line that loads; records recovered behind a broken quote of a line that does not load count from 1.
    """
    keep = ["line_id", "assessment_id", "file_id", "file_kind", "line_no"]
    whole = parsed.where("reason is null").select(*keep, F.lit(0).alias("part"), "cells", "vcpu")
    behind = parsed.where("reason is not null").select(*keep, F.posexplode("recovered").alias("i", "r")).where("r.detail is null").select(*keep, (F.col("i") + 1).alias("part"), "r.cells", "r.vcpu")
    cell = lambda name: F.nullif(F.trim(F.element_at("cells", F.lit(name))), F.lit(""))
    return whole.unionByName(behind).select(
        *keep, "part", cell("hostname").alias("hostname"), cell("role").alias("role"), cell("os").alias("os"), "vcpu",
        cell("memory_gb").try_cast("double").alias("memory_gb"), cell("disk_gb").try_cast("double").alias("disk_gb"), cell("datacenter").alias("datacenter"), F.element_at("cells", F.lit("notes")).alias("notes"),
    )
