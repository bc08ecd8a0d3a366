"""Small expressions about quotes, places in documents and texts that are shown to a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estateloom.functions.keys import col


def locator(path: Column, summary: Column, first_row: Column, last_row: Column, question: Column, sheet: Column, page: Column, filename: Column) -> Column:
    """Where in its document a piece stands, by the most telling of what is known: path, summary, rows, question, sheet, page of a PDF; else null."""
    on_sheet = F.coalesce(F.concat(F.lit('sheet "'), sheet, F.lit('", ')), F.lit(""))
    rows = F.when(last_row == first_row, F.concat(F.lit("row "), last_row)).otherwise(F.concat(F.lit("rows "), first_row, F.lit("–"), last_row))
    return F.coalesce(
        path, F.when(summary, F.concat(on_sheet, F.lit("computed summary"))), F.concat(on_sheet, rows), F.concat(F.lit("Q"), question), F.concat(F.lit('sheet "'), sheet, F.lit('"')),
        F.when(F.lower(filename).endswith(".pdf"), F.concat(F.lit("p. "), page)),
    )


def complete_quote(text: Column | str, quote: Column | str, most: int = 280) -> Column:
    """The first line of ``text`` that holds the quote, unless it is longer than ``most`` or a heading; else the quote."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    needle = F.lower(flat(col(quote)))
    lines = F.filter(F.transform(F.split(col(text), "\n"), flat), lambda x: F.lower(x).contains(needle) & (F.length(x) <= most) & ~x.startswith("#"))
    return F.when(needle == "", col(quote)).otherwise(F.coalesce(F.get(lines, F.lit(0)), col(quote)))


def fenced(text: Column | str) -> Column:
    """Text in which no tag can close the fence around a chunk: a zero-width space stands in such tags."""
    return F.regexp_replace(col(text), r"(?i)<(/?\s*chunk)\b", "<​$1")


def search_text(context: Column | str, text: Column | str) -> Column:
    """What is indexed of a piece: its context, a blank line, its text; one alone if the other is missing."""
    return F.concat_ws("\n\n", F.nullif(F.trim(col(context)), F.lit("")), col(text))


def question_tokens(text: Column | str) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP)))


# Words that say nothing of what a question is about.
STOP = [
    "the", "and", "for", "with", "from", "what", "which", "who", "how", "are", "is", "there", "known", "does", "do", "a", "an", "of", "in", "to", "on", "or", "this", "that", "any", "question",
]
