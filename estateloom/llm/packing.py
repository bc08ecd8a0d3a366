"""Whole texts into contexts of fixed capacity: vector best-fit over tokens, documents and attention cost.

Only texts longer than a context are cut: their full pieces fill contexts by themselves, the rest is an item like any
other. Items are dealt by hash into shards of a bounded number of items, and each shard is packed by itself, largest item
first, into the bin whose weighted residual fits the item best while every constraint holds. A shard leaves at most a few
bins part empty, so the loss against one global packing is a few bins in ``SHARD_ITEMS`` items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estateloom.llm.tokenizing import VOCABULARY, sized

CAPACITY = 2048
MAX_DOCUMENTS = 64
SHARD_ITEMS = 8192
WEIGHTS = (1.0, 0.1, 0.1)


def best_fit(sizes: np.ndarray, capacity: int, max_documents: int, max_attention: float, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Bin of each item. ``rule``: ``norm`` takes the bin with the least weighted residual norm after the item is in, ``dot``
    the one with the largest weighted dot product of item and residual. An item that breaks a constraint alone gets its own bin."""
    caps = np.array([capacity, max_documents, max_attention], dtype=float)
    w = np.array(weights, dtype=float)
    bins = np.full(len(sizes), -1, dtype=np.int64)
    residual = np.empty((max(16, len(sizes)), 3))
    numbers = np.empty(len(residual), dtype=np.int64)
    n_open = n_bins = 0
    least = float(sizes.min()) if len(sizes) else 0.0
    for i in np.argsort(-sizes, kind="stable"):
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        at = -1
        if n_open:
            r = residual[:n_open]
            fits = np.flatnonzero((r[:, 0] >= need[0]) & (r[:, 1] >= need[1]) & (r[:, 2] >= need[2]))
            if len(fits):
                left = (r[fits] - need) / caps
                score = -(w * left**2).sum(axis=1) if rule == "norm" else (w * (r[fits] / caps) * (need / caps)).sum(axis=1)
                at = int(fits[np.argmax(score)])
        if at < 0:
            residual[n_open], numbers[n_open], at = caps, n_bins, n_open
            n_open, n_bins = n_open + 1, n_bins + 1
        residual[at] -= need
        bins[i] = numbers[at]
        if residual[at, 0] < least or residual[at, 1] < 1 or residual[at, 2] < least**2:
            n_open -= 1  # nothing can follow into this bin
            residual[at], numbers[at] = residual[n_open], numbers[n_open]
    return bins


def packed(
    documents: DataFrame,
    capacity: int = CAPACITY,
    max_documents: int = MAX_DOCUMENTS,
    max_attention: float | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
    vocabulary: str = VOCABULARY,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """(container_id, doc_id, piece_no, start_token, n_tokens): every text, whole unless longer than ``capacity``.

    ``max_attention`` bounds the sum of squared piece lengths of a container; by default it is that of one full piece, which
    no container of several texts reaches, so only the tokens and documents bind. A lower bound makes long texts share a
    container with short ones; a text that exceeds it alone has a container of its own.

    Edge cases: null and empty texts have no tokens and come out once with a null container; repeated texts are packed each
    time; ties in size go by ``doc_id``; an empty table gives an empty table; further columns are ignored.
    """
    attention = float(capacity) ** 2 if max_attention is None else float(max_attention)
    shards = max(1, -(-documents.count() // shard_items))
    texts = sized(documents, ["doc_id"], vocabulary)
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1)),
        lambda k: F.struct(k.cast("int").alias("piece_no"), (k * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - k * capacity).alias("size")),
    )
    cut = texts.select("doc_id", F.inline(pieces)).withColumn(
        "shard", F.when((F.col("size") > 0) & (F.col("size") < capacity), F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)))
    )  # full pieces and empty texts need no shard
    alone = cut.where("shard is null").select(
        F.when(F.col("size") > 0, F.concat_ws("-", F.lit("full"), "doc_id", "piece_no")).alias("container_id"), "doc_id", "piece_no", "start_token", F.col("size").alias("n_tokens")
    )

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "piece_no"], ignore_index=True)
        bins = best_fit(shard["size"].to_numpy(), capacity, max_documents, attention, rule, weights)
        ids = [f"{s}-{b}" for s, b in zip(shard["shard"], bins, strict=True)]
        return pd.DataFrame({"container_id": ids, "doc_id": shard["doc_id"], "piece_no": shard["piece_no"], "start_token": shard["start_token"], "n_tokens": shard["size"]})

    schema = "container_id string, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"
    return alone.select("container_id", "doc_id", "piece_no", F.col("start_token").cast("bigint"), F.col("n_tokens").cast("bigint")).unionByName(cut.where("shard is not null").groupBy("shard").applyInPandas(pack, schema))


def utilisation(packing: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_attention: float | None = None) -> DataFrame:
    """Containers, their tokens, the share of used space, the fewest containers that any packing needs (by the scarcest of the
    three capacities), how many containers are up against each of them, and the fullest."""
    attention = float(capacity) ** 2 if max_attention is None else float(max_attention)
    squares = F.col("n_tokens").cast("double") * F.col("n_tokens")
    per = packing.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.sum(squares).alias("attention"))
    least = F.greatest(F.ceil(F.sum("tokens") / capacity), F.ceil(F.count_if(F.col("documents") > 0) * F.avg("documents") / max_documents), F.ceil(F.sum(F.least("attention", F.lit(attention))) / attention))
    return per.agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * capacity)).alias("utilisation"), least.alias("least_containers"),
        F.max("tokens").alias("most_tokens"), F.max("documents").alias("most_documents"), F.count_if(F.col("documents") >= max_documents).alias("full_by_documents"),
        F.count_if(F.col("attention") >= 0.95 * attention).alias("full_by_attention"), F.count_if(F.col("tokens") >= 0.95 * capacity).alias("full_by_tokens"),
    )


def violations(packing: DataFrame, documents: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_attention: float | None = None) -> DataFrame:
    """One row: texts packed, texts missing or packed twice, texts cut though they fit, and containers beyond each capacity
    (a single piece beyond the attention bound has its own container and is none)."""
    attention = float(capacity) ** 2 if max_attention is None else float(max_attention)
    per = packing.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("attention"))
    bins = per.agg(F.count_if(F.col("tokens") > capacity).alias("over_tokens"), F.count_if(F.col("pieces") > max_documents).alias("over_documents"), F.count_if((F.col("attention") > attention) & (F.col("pieces") > 1)).alias("over_attention"))
    texts = packing.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.countDistinct("start_token").alias("starts"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    whole = (F.col("starts") == F.col("pieces")) & (F.col("end") == F.col("tokens"))
    all_ = documents.select("doc_id").join(texts, "doc_id", "left").agg(
        F.count("pieces").alias("texts"), F.count_if(F.col("pieces").isNull() | ~whole).alias("not_whole"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("cut_without_need")
    )
    return all_.crossJoin(bins)  # one row each
