"""Texts into chunks: paragraphs, character windows, token packing, sections, context. All per row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estateloom.functions.keys import col

CHUNK_TOKENS, OVERLAP_TOKENS = 600, 80


def n_tokens(c: Column) -> Column:
    """The size estimate where no tokenizer is at hand: a token per four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def paragraph_array(text: Column | str) -> Column:
    parts = F.transform(F.split(col(text), r"\n[ \t]*(?:\n[ \t]*)++"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, part, parts, paragraph, before, after): each paragraph as part i of n, with the tail of the one before (160) and the head of the next (600)."""
    p = documents.select("doc_id", paragraph_array("text").alias("p"))
    rows = F.transform(
        "p",
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("part"), F.size("p").alias("parts"), x.alias("paragraph"),
            F.when(i > 0, F.right(F.get("p", i - 1), F.lit(160))).alias("before"), F.left(F.get("p", i + 1), F.lit(600)).alias("after"),
        ),
    )
    return p.select("doc_id", F.inline(rows))


def paragraph_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, part, offset_start, offset_end, paragraph) with real offsets into the text, found forward from the last end."""
    p = documents.select("doc_id", "text", paragraph_array("text").alias("p"))
    initial = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<part:int,offset_start:int,offset_end:int,paragraph:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = F.call_function("locate", x, F.col("text"), acc["at"] + 1) - 1
        row = F.struct((F.size(acc["out"]) + 1).alias("part"), start.alias("offset_start"), (start + F.length(x)).alias("offset_end"), x.alias("paragraph"))
        return F.struct((start + F.length(x)).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return p.select("doc_id", F.inline(F.aggregate("p", initial, add)["out"]))


def char_windows(documents: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(doc_id, window_no, start_pos, piece): overlapping windows over the whole text; empty texts have none."""
    n = F.length("text")
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    rows = F.transform(at, lambda s, i: F.struct(i.cast("int").alias("window_no"), s.cast("int").alias("start_pos"), F.substring("text", s + 1, F.lit(size)).alias("piece")))
    return documents.where(n > 0).select("doc_id", F.inline(rows))


def windowed(parts: Column, budget: int, overlap: int) -> Column:
    """Parts longer than ``budget`` tokens cut into windows of that size that overlap; the others as they are."""
    size, step = budget * 4, max(1, (budget - overlap) * 4)
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - overlap * 4 - 1, F.lit(0)), F.lit(step)), lambda at: F.substring(x, at + 1, F.lit(size)))
    return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > size, cut(x)).otherwise(F.array(x))))


def packed_chunks(documents: DataFrame, budget: int = CHUNK_TOKENS, cut_long: bool = False) -> DataFrame:
    """(doc_id, chunk_no, n_paragraphs, tokens, chunk): paragraphs packed in order until the budget is reached.

    A longer paragraph stands alone, with ``cut_long`` in overlapping windows of the budget's size.
    """
    paragraphs_ = paragraph_array("text")
    p = documents.select("doc_id", (windowed(paragraphs_, budget, OVERLAP_TOKENS) if cut_long else paragraphs_).alias("p"))
    kind = "array<struct<n:int,t:int,x:string>>"
    initial = F.array().cast(kind)

    def add(acc: Column, x: Column) -> Column:
        t = n_tokens(x)
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["t"], F.lit(0)) + t <= budget)
        merged = F.struct((last["n"] + 1).alias("n"), (last["t"] + t).alias("t"), F.concat_ws("\n\n", last["x"], x).alias("x"))
        own = F.struct(F.lit(1).alias("n"), t.alias("t"), x.alias("x"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(own))).cast(kind)

    chunks = F.aggregate("p", initial, add)
    return p.select("doc_id", F.posexplode(chunks).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.col("c.n").alias("n_paragraphs"), F.col("c.t").alias("tokens"), F.col("c.x").alias("chunk"))


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, body_chars): a section from each heading to the next; what stands before the first has number -1."""
    marked = F.split(F.regexp_replace("text", r"(^|\n)(#{1,6} )", "$1\u0001$2"), "\u0001")
    rows = documents.where("text is not null").select("doc_id", F.posexplode(marked).alias("i", "body"))
    title = F.regexp_extract("body", r"^#{1,6} +([^\n]*)", 1)
    return rows.where((F.col("i") > 0) | (F.trim("body") != "")).select("doc_id", (F.col("i") - 1).cast("int").alias("section_no"), F.trim(title).alias("title"), F.length("body").alias("body_chars"))


_QUESTION_LINE = r"(^|\n)([ \t]*[Qq][0-9]{0,3}[.:)])"


def question_chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, qa_index, chunk): a question line and what follows it up to the next; what stands before the first has index -1, and
    so has a text without questions. Blank pieces are left out."""
    pieces = F.split(F.regexp_replace("text", _QUESTION_LINE, "$1\u0001$2"), "\u0001")
    rows = documents.where("text is not null").select("doc_id", F.posexplode(pieces).alias("i", "piece"))
    return rows.select("doc_id", (F.col("i") - 1).cast("int").alias("qa_index"), F.regexp_replace("piece", r"^\s+|\s+$", "").alias("chunk")).where("chunk <> ''")


def manifest_chunks(files: DataFrame, budget: int = CHUNK_TOKENS) -> DataFrame:
    """(file_id, part, chunk): a file's paragraphs packed within the budget, its path before the first piece; an empty file is that line alone."""
    chunks = packed_chunks(files.select(F.col("file_id").alias("doc_id"), "text"), budget, cut_long=True).select(F.col("doc_id").alias("file_id"), F.col("chunk_no").alias("part"), "chunk")
    heads = files.select("file_id", F.concat(F.lit("# FILE: "), F.coalesce("relative_path", F.lit("")), F.lit("\n")).alias("head"))
    joined = heads.join(chunks, "file_id", "left").select("file_id", F.coalesce("part", F.lit(0)).alias("part"), "head", F.coalesce("chunk", F.lit("")).alias("chunk"))
    return joined.select("file_id", "part", F.when(F.col("part") == 0, F.concat("head", "chunk")).otherwise(F.col("chunk")).alias("chunk"))


def routed_chunks(documents: DataFrame, tables: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, route, chunk_no, size): questionnaires by questions, inventories by the rows of their tables (``tables`` gives doc_id and
    n_rows of each chunk), all others by paragraphs; size is in characters, of tables in rows."""
    kind = F.coalesce("source", F.lit(""))
    asked = question_chunks(documents.where(kind == "questionnaire")).select("doc_id", F.lit("questionnaire").alias("route"), F.col("qa_index").alias("chunk_no"), F.length("chunk").alias("size"))
    listed = tables(documents.where(kind == "inventory_notes"))
    numbered = listed.select("doc_id", F.lit("inventory").alias("route"), F.col("part").alias("chunk_no"), F.col("n_rows").alias("size"))
    prose = packed_chunks(documents.where(~kind.isin("questionnaire", "inventory_notes")), cut_long=True).select("doc_id", F.lit("prose").alias("route"), "chunk_no", F.length("chunk").alias("size"))
    return asked.unionByName(numbered).unionByName(prose)


def plain_text(c: Column | str) -> Column:
    """Markdown without its marks: fences, rules, headings, bullets, links, code, emphasis; blank lines squeezed."""
    t = col(c)
    for pattern, by in [
        (r"(?m)^```.*$", ""), (r"(?m)^\s*\|?[\s|:-]*-[\s|:-]*\|?\s*$", ""), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]*)`", "$1"),
        (r"\*\*([^*]+)\*\*", "$1"), (r"\n{3,}", "\n\n"),
    ]:
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)


def overlapped_chunks(documents: DataFrame, budget: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(doc_id, chunk_no, carried, chunk): packed chunks that start with the last sentences of the chunk before, up to ``overlap`` tokens.

    Nothing is carried if the whole chunk before would fit.
    """
    chunks = packed_chunks(documents, budget).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "tokens", "chunk"))).alias("c"))

    def tail(previous: Column) -> Column:
        sentences = F.reverse(F.split(previous["chunk"], r"(?<=[.!?])\s+"))
        kind = "struct<t:int,open:boolean,out:array<string>>"
        initial = F.struct(F.lit(0).alias("t"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("out")).cast(kind)

        def add(acc: Column, s: Column) -> Column:
            fits = acc["open"] & (acc["t"] + n_tokens(s) <= overlap)
            return F.when(fits, F.struct((acc["t"] + n_tokens(s)).alias("t"), F.lit(True).alias("open"), F.concat(F.array(s), acc["out"]).alias("out"))).otherwise(
                F.struct(acc["t"].alias("t"), F.lit(False).alias("open"), acc["out"].alias("out"))
            ).cast(kind)

        return F.when(previous["tokens"] > overlap, F.array_join(F.aggregate(sentences, initial, add)["out"], " ")).otherwise("")

    rows = F.transform("c", lambda x, i: F.struct(x["chunk_no"].alias("chunk_no"), F.when(i > 0, tail(F.get("c", i - 1))).otherwise("").alias("carried"), x["chunk"].alias("chunk")))
    return chunks.select("doc_id", F.inline(rows))
