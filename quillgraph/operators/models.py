"""Pluggable models and their defaults: vectors of texts, summaries of communities.

A model is a function from a pandas frame to a pandas frame; it runs on Arrow batches where the rows are. The
defaults are deterministic and need no model: hashed term vectors, and a fixed sentence.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import auto_summary
from .linking import in_batches

#: Components of a hashed vector: two hexadecimal digits of a word's MD5.
DIM = 256
#: Words that a batch remembers the places of.
REMEMBERED = 200_000


def _place(word: str) -> tuple[int, int]:
    """Component and sign of a word, from its MD5."""
    h = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
    return int(h[:2], 16), 1 if h[2] < "8" else -1


def hashed_vectors(batch: pd.DataFrame) -> pd.DataFrame:
    """The default embedder: signed counts of lower-cased words (cut at ASCII white space), hashed to ``DIM`` components, at unit length. Texts without a word have a zero vector."""
    known: dict[str, tuple[int, int]] = {}
    out = []
    for text in batch["text"]:
        v = np.zeros(DIM)
        for word, n in Counter(w for w in (text or "").lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\f", " ").replace("\v", " ").split(" ") if w).items():
            if word not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = _place(word)
            at, sign = known[word]
            v[at] += sign * n
        length = np.sqrt((v**2).sum())
        out.append(v / length if length else v)
    return pd.DataFrame({"id": batch["id"], "v": out})


def embed(texts: DataFrame, id_col: str, text_col: str, model: Callable[[pd.DataFrame], pd.DataFrame] = hashed_vectors) -> DataFrame:
    """``id_col, v`` (array<double>) of every row with an id, by a model over batches of (id, text); no shuffle. Null texts are empty."""
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where("id is not null")
    return in_batches(rows, model, f"id {dict(texts.dtypes)[id_col]}, v array<double>").withColumnRenamed("id", id_col)


def described(membership: DataFrame, entities: DataFrame, most: int = 30) -> DataFrame:
    """``community_id, n, labels``: each community's size and its first ``most`` members' labels by node. entities: node, label; nodes without a label are counted only."""
    rows = membership.select("community_id", "node").distinct()
    sizes = rows.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("community_id").orderBy("node")
    first = rows.join(entities.select("node", "label").where("label is not null"), "node").withColumn("i", F.row_number().over(place)).where(F.col("i") <= most)
    lists = first.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]).alias("labels"))
    return sizes.join(lists, "community_id", "left").select("community_id", "n", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def summarise(communities: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """``community_id, summary`` of communities (community_id, n, labels), by a model over batches of these; without one a fixed sentence, and for communities that the model gives null or an empty text too."""
    plain = communities.select("community_id", auto_summary(F.col("labels"), F.col("n")).alias("summary"))
    if model is None:
        return plain
    said = in_batches(communities, model, f"community_id {dict(communities.dtypes)['community_id']}, summary string")
    said = said.select("community_id", F.nullif(F.trim("summary"), F.lit("")).alias("said_"))
    return plain.join(said, "community_id", "left").select("community_id", F.coalesce("said_", "summary").alias("summary"))
