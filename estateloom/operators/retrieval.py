"""Search: exact vectors, Okapi BM25 and keyword scores over blocks of queries and buckets of items, an inverted-file index, rank fusion, query expansion.

Queries meet items tile by tile: items are dealt by hash into buckets, queries into blocks, and each tile, of bounded size,
emits only its ``k`` best items per query. So no pair that cannot be among a query's best leaves a task, no word or cluster
is hot, and nothing is collected or broadcast.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estateloom.functions.keys import col
from estateloom.session import written

TOP_K = 8
#: items of a tile and queries of a tile, about
BUCKET, QUERY_BLOCK = 50_000, 4096
#: words in Latin letters and digits; words of any script, characters of Chinese and Japanese by themselves
LATIN_WORDS = "[a-z0-9]+"
ANY_WORDS = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]|[a-z0-9\x{00DF}-\x{02AF}\x{0370}-\x{1FFF}]+"


def tokens(text: Column | str, words: str = LATIN_WORDS) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(words), F.lit(0))


def _ranked(scores: DataFrame, k: int, query: str, item: str) -> DataFrame:
    """The ``k`` best items per query; ties go to the lower item."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def in_tiles(items: DataFrame, queries: DataFrame, item: str, query: str, n_items: int, n_queries: int, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, bucket: int = BUCKET, block: int = QUERY_BLOCK) -> DataFrame:
    """``score`` of (rows of ``items``, rows of ``queries``) for every tile; rows of one ``item``, or one ``query``, share their tiles.

    Small inputs are dealt into as many buckets as there are cores, so that they keep them busy.
    """
    cores = items.sparkSession.sparkContext.defaultParallelism
    buckets, blocks = max(1, -(-n_items // bucket), min(cores, -(-n_items // 1000))), max(1, -(-n_queries // block))
    left = items.withColumn("__bucket", F.pmod(F.xxhash64(item), F.lit(buckets))).withColumn("__block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    right = queries.withColumn("__block", F.pmod(F.xxhash64(query), F.lit(blocks))).withColumn("__bucket", F.explode(F.expr(f"sequence(0L, {buckets - 1}L)")))
    return left.groupBy("__bucket", "__block").cogroup(right.groupBy("__bucket", "__block")).applyInPandas(score, schema)


def _cosine_best(k: int, least: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def unit(pdf: pd.DataFrame) -> np.ndarray:
        m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    def best(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(vectors) or not len(asked):
            return out
        vectors = vectors.sort_values("vec_id", ignore_index=True)
        ids, v, q = vectors["vec_id"].to_numpy(), unit(vectors), unit(asked)
        found = []
        for at in range(0, len(q), 64):  # rows of scores that are held at once
            s = np.round(q[at : at + 64] @ v.T, 6)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids rise, so ties go to the lower
            scores = np.take_along_axis(s, top, axis=1)
            keep = scores > least
            asked_ids = np.repeat(asked["query_id"].to_numpy()[at : at + 64, None], top.shape[1], axis=1)
            found.append(pd.DataFrame({"query_id": asked_ids[keep], "vec_id": ids[top][keep], "score": scores[keep]}))
        return pd.concat([out, *found], ignore_index=True)

    return best


_HITS = "query_id bigint, vec_id bigint, score double"


def nearest_vectors(embeddings: DataFrame, queries: DataFrame, k: int = TOP_K, least: float = 0.02, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, place): exact cosine of every query against every vector, the best ``k`` above ``least``.

    Null vectors and vectors of zeros match nothing.
    """
    vectors = embeddings.select("vec_id", "embedding").where("embedding is not null")
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding").where("embedding is not null")
    return _ranked(in_tiles(vectors, asked, "vec_id", "query_id", vectors.count(), asked.count(), _cosine_best(k, least), _HITS, block=block), k, "query_id", "vec_id")


def nearest_by_index(embeddings: DataFrame, queries: DataFrame, k: int = TOP_K, least: float = 0.02, cells: int = 64, probes: int = 40, sample: int = 20_000) -> DataFrame:
    """(query_id, vec_id, score, place) by an inverted file: each vector lies in the cell of its nearest centre, each query
    looks into the cells of its ``probes`` nearest centres; scores are exact, vectors of other cells are missed.

    The centres are vectors of a share of about ``sample`` rows, drawn by a hash of the id and thinned to ``cells``; every
    vector is indexed. A cell of any size is dealt into buckets. ``recall_at_k`` in the tests holds it against the exact way.
    """
    vectors = embeddings.select("vec_id", "embedding").where("embedding is not null")
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * share))
    centres = written(drawn.orderBy(F.xxhash64("vec_id", F.lit(2))).limit(cells).select(F.collect_list(F.struct("vec_id", "embedding")).alias("centres")))  # one row of ``cells`` vectors

    def placed(rows: DataFrame, most: int) -> DataFrame:
        dot = lambda c: F.aggregate(F.zip_with(c["embedding"], F.col("embedding"), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda x, y: x + y)
        norm = lambda c: F.sqrt(F.aggregate(c["embedding"], F.lit(0.0), lambda x, y: x + y.cast("double") * y))
        near = F.slice(F.reverse(F.array_sort(F.transform("centres", lambda c: F.struct((dot(c) / F.greatest(norm(c), F.lit(1e-12))).alias("s"), c["vec_id"].alias("cell"))))), 1, most)
        return rows.crossJoin(F.broadcast(centres)).select(*rows.columns, F.explode(near).alias("near")).select(*rows.columns, F.col("near.cell").alias("cell"))

    held = written(placed(vectors, 1).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // BUCKET))))))
    parts = held.select("cell", "part").distinct().select(F.col("cell").alias("in_cell"), F.col("part").alias("in_part"))
    asked = placed(queries.select(F.col("vec_id").alias("query_id"), "embedding").where("embedding is not null"), probes).join(parts, F.col("cell") == F.col("in_cell")).drop("cell")
    hits = held.groupBy("cell", "part").cogroup(asked.groupBy("in_cell", "in_part")).applyInPandas(_cosine_best(k, least), _HITS)
    return _ranked(hits, k, "query_id", "vec_id")


def postings(documents: DataFrame, words: str = LATIN_WORDS) -> DataFrame:
    """(doc_id, dl, word, tf): how often each word occurs in a document of ``dl`` words."""
    cut = documents.select("doc_id", tokens("text", words).alias("t"))
    return cut.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("word")).groupBy("doc_id", "dl", "word").agg(F.count("*").alias("tf"))


def bm25(
    documents: DataFrame, queries: DataFrame, k: int = TOP_K, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, counted: bool = False, words: str = LATIN_WORDS, index: DataFrame | None = None
) -> DataFrame:
    """(query_id, doc_id, score, place): Okapi BM25 of each query's distinct words (``counted``: each as often as it occurs); scores above 0.

    ``queries`` has query_id and text. Documents are cut into words once, into a table of postings that can be given as
    ``index``; those of asked words meet the queries in tiles, where words are 64-bit hashes. Negative inverse frequencies become ``epsilon`` times the mean.
    """
    index = written(postings(documents, words)) if index is None else index
    n = documents.count()
    df = index.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
    idf = written(df.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    mean, total = idf.agg(F.avg("idf"), F.sum("occurrences")).first()
    mean, avgdl = mean or 0.0, max((total or 0) / max(n, 1), 1e-9)
    asked = queries.select("query_id", F.explode(tokens("text", words) if counted else F.array_distinct(tokens("text", words))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
    wanted = asked.join(idf.select("word", F.when(F.col("idf") < 0, epsilon * mean).otherwise(F.col("idf")).alias("idf")), "word").select("query_id", "word", F.xxhash64("word").alias("wid"), (F.col("idf") * F.col("times")).alias("gain"))
    wanted = written(wanted)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    needed = index.join(wanted.select("word").distinct(), "word", "left_semi").select("doc_id", F.xxhash64("word").alias("wid"), weight.alias("weight"))
    query_type, doc_type = dict(wanted.dtypes)["query_id"], dict(needed.dtypes)["doc_id"]

    def best(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "doc_id": [], "score": []}
        if len(found) and len(asked):
            ids, at = np.unique(found["doc_id"].to_numpy(), return_inverse=True)
            order = np.argsort(found["wid"].to_numpy(), kind="stable")
            names, first = np.unique(found["wid"].to_numpy()[order], return_index=True)
            spans = {w: order[i:j] for w, i, j in zip(names.tolist(), first, [*first[1:], len(order)], strict=True)}
            weights = found["weight"].to_numpy()
            for query, rows in asked.groupby("query_id", sort=False):
                scores = np.zeros(len(ids))
                for w, gain in zip(rows["wid"].tolist(), rows["gain"].tolist(), strict=True):
                    if (span := spans.get(w)) is not None:
                        scores[at[span]] += gain * weights[span]  # a document has a word once
                scores = np.round(scores, 4)
                top = np.argsort(-scores, kind="stable")[:k]
                top = top[scores[top] > 0]
                out["query_id"] += [query] * len(top)
                out["doc_id"] += ids[top].tolist()
                out["score"] += scores[top].tolist()
        return pd.DataFrame(out).astype({"score": "float64"})

    n_queries = wanted.select("query_id").distinct().count()
    hits = in_tiles(needed, wanted.select("query_id", "wid", "gain"), "doc_id", "query_id", n, n_queries, best, f"query_id {query_type}, doc_id {doc_type}, score double", bucket=5000, block=1000)
    return _ranked(hits, k, "query_id", "doc_id")


def fused(rankings: list[tuple[DataFrame, float]], k: int = TOP_K, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, place) lists with weights; ties go to the item seen first, then the lower id.

    A frame that holds several lists numbers them in a column ``seen``; all frames then need one.
    """
    parts = [r.select("query_id", "doc_id", (F.lit(w) / (constant + F.col("place"))).alias("part"), (F.col("seen") if "seen" in r.columns else F.lit(i)).alias("seen"), "place") for i, (r, w) in enumerate(rankings)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    scores = union.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 8).alias("score"), F.min(F.struct("seen", "place")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "doc_id"))
    return scores.withColumn("place", place).where(F.col("place") <= k).select("query_id", "doc_id", "score", "place")


def hashed_embeddings(documents: DataFrame, dims: int = 64, postings_of: DataFrame | None = None) -> DataFrame:
    """(vec_id, embedding): a signed hash of the words, for corpora without a model; documents without words have none."""
    words = postings(documents) if postings_of is None else postings_of
    h = F.xxhash64("word")
    sign = F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, F.col("tf")).otherwise(-F.col("tf"))
    cells = words.groupBy("doc_id", F.pmod(h, F.lit(dims)).cast("int").alias("cell")).agg(F.sum(sign).cast("double").alias("x"))
    filled = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "x"))).alias("m"))
    return filled.select(F.col("doc_id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)).cast("float")).alias("embedding"))


def hybrid(documents: DataFrame, queries: DataFrame, k: int = TOP_K, pool: int | None = None) -> DataFrame:
    """Dense and lexical rankings of ``pool`` candidates each (by default the larger of 4k and 20), fused.

    Expansions of a query enter with ``EXPANSION_WEIGHT``: one dense list each, and one lexical list of all of them. Few
    expansions exist, so each is searched once and its ranking joined to the queries that have it.
    """
    pool = pool or max(4 * k, 20)
    index = written(postings(documents))  # words of the documents, read by both lexical rankings and by the vectors
    vectors = written(hashed_embeddings(documents, postings_of=index))
    dense = nearest_vectors(vectors, hashed_embeddings(queries.select(F.col("query_id").alias("doc_id"), "text")), pool).withColumnRenamed("vec_id", "doc_id")
    phrases = sorted({p for _, said in CONCEPTS.values() for p in said})
    listed = documents.sparkSession.createDataFrame(list(enumerate(phrases)), "doc_id bigint, text string")
    said = expansions(queries.select(F.col("query_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("query_id"), F.split("expansions", "; ").alias("said"))
    near = nearest_vectors(vectors, hashed_embeddings(listed), pool).select(F.col("query_id").alias("phrase"), F.col("vec_id").alias("doc_id"), "place")
    each = said.select("query_id", F.posexplode("said").alias("at", "text")).join(F.broadcast(listed.withColumnRenamed("doc_id", "phrase")), "text")
    dense_said = each.join(near, "phrase").select("query_id", "doc_id", "place", (F.col("at") + 1).alias("seen"))
    joined = said.select("query_id", F.array_join("said", " ").alias("text"))
    words = bm25(documents, joined.select(F.col("text").alias("query_id"), "text").distinct(), pool, counted=True, index=index).select(F.col("query_id").alias("text"), "doc_id", "place")
    lexical_said = joined.join(words, "text").select("query_id", "doc_id", "place", F.lit(MAX_EXPANSIONS + 2).alias("seen"))
    lexical = bm25(documents, queries, pool, counted=True, index=index).withColumn("seen", F.lit(MAX_EXPANSIONS + 1))
    return fused([(dense.withColumn("seen", F.lit(0)), 1.0), (dense_said, EXPANSION_WEIGHT), (lexical, 1.0), (lexical_said, EXPANSION_WEIGHT)], k)


# Concepts, the words that mention them, and how documents speak of them.
CONCEPTS = {
    "technical_debt": (
        ["technical debt", "tech debt", "legacy", "modernization", "modernisation"],
        ["legacy end-of-life unsupported version upgrade required deprecated", "manual process manual failover workaround hand-run procedure", "tight coupling tightly coupled monolith shared database coupling", "hardcoded configuration single point of failure brittle"],
    ),
    "blockers": (
        ["blocker", "blockers", "impediment", "impediments", "constraint", "constraints", "migration risk", "migration risks", "cannot migrate", "showstopper"],
        ["cannot move before must remain freeze window batch window", "re-certification certification audit required before migration", "migration sequencing moves first moves last prerequisite order", "coupling dependency must migrate together licensing contract end date"],
    ),
    "resilience": (
        ["high availability", "resilience", "resiliency", "disaster recovery", "business continuity", "failover"],
        ["failover standby replica manual failover procedure", "rto rpo backup restore recovery time", "redundancy zone-redundant single point of failure"],
    ),
    "compliance": (["compliance", "regulatory", "security requirements", "audit"], ["PCI PCI-DSS HIPAA SOX GDPR controls", "encryption at rest in transit TLS AES", "data residency in-region re-certification"]),
    "capacity": (["performance", "capacity", "scalability", "peak load"], ["latency throughput requests per second concurrent users", "cpu memory utilization headroom peak month-end"]),
    "dependencies": (["dependencies", "dependency", "integration", "integrations", "interfaces"], ["depends on calls integrates with upstream downstream", "api queue kafka event hub message topic"]),
}
MAX_EXPANSIONS = 4
#: weight of an expansion's ranking, that of the query's own being 1
EXPANSION_WEIGHT = 0.6


def expansions(documents: DataFrame) -> DataFrame:
    """(doc_id, concepts, expansions): concepts that a text mentions in whole words, and up to four expansions taken from them in turn."""
    words = F.concat(F.lit(" "), F.array_join(tokens("text"), " "), F.lit(" "))
    named = documents.select("doc_id", words.alias("w"))
    hit = F.array_compact(
        F.array(*(F.when(F.exists(F.array(*(F.lit(f" {t} ") for t in triggers)), lambda t: F.col("w").contains(t)), F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, said)).alias("said"))) for n, (triggers, said) in CONCEPTS.items()))
    )
    depth = max(len(said) for _, said in CONCEPTS.values())
    turns = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.array_compact(F.transform("hit", lambda c: F.get(c["said"], d)))))
    found = named.withColumn("hit", hit).where(F.size("hit") > 0)
    return found.select("doc_id", F.array_join(F.col("hit.name"), ",").alias("concepts"), F.array_join(F.slice(F.array_distinct(turns), 1, MAX_EXPANSIONS), "; ").alias("expansions"))


def keyword_search(documents: DataFrame, queries: DataFrame, k: int = TOP_K, block: int = 5000) -> DataFrame:
    """(query_id, doc_id, score, place): how many of a query's words of three letters or more stand in a text, as substrings.

    Texts and queries meet in tiles; in a tile one automaton of all asked words reads each text once.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 2))
    wanted = queries.select("query_id", words.alias("words")).where(F.size("words") > 0)
    texts = documents.where("text is not null").select("doc_id", F.lower("text").alias("low"))
    query_type, doc_type = dict(wanted.dtypes)["query_id"], dict(texts.dtypes)["doc_id"]

    def best(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        out: dict[str, list] = {"query_id": [], "doc_id": [], "score": []}
        if len(found) and len(asked):
            askers: dict[str, list[int]] = {}
            for i, said in enumerate(asked["words"]):
                for w in said:
                    askers.setdefault(w, []).append(i)
            automaton = ahocorasick.Automaton()
            for w in askers:
                automaton.add_word(w, w)
            automaton.make_automaton()
            # the best so far of each query; texts come by rising id, so ties go to the lower
            tops: list[list[tuple[int, int]]] = [[] for _ in range(len(asked))]
            order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
            ids, lows = found["doc_id"].to_numpy()[order], found["low"].to_numpy()[order]
            for at, low in enumerate(lows):
                scores: dict[int, int] = {}
                for w in {w for _, w in automaton.iter(low)}:
                    for i in askers[w]:
                        scores[i] = scores.get(i, 0) + 1
                for i, n in scores.items():
                    top = tops[i]
                    if len(top) < k or n > -top[-1][0]:
                        bisect.insort(top, (-n, at))
                        del top[k:]
            for query, top in zip(asked["query_id"], tops, strict=True):
                out["query_id"] += [query] * len(top)
                out["doc_id"] += [ids[at] for _, at in top]
                out["score"] += [-n for n, _ in top]
        return pd.DataFrame(out).astype({"score": "int64"})

    hits = in_tiles(texts, wanted, "doc_id", "query_id", texts.count(), wanted.count(), best, f"query_id {query_type}, doc_id {doc_type}, score bigint", bucket=10_000, block=block)
    return _ranked(hits, k, "query_id", "doc_id")
