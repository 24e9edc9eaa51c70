"""Exact vector search over note embeddings, and its fusion with full-text search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from noteql.functions import extract
from noteql.functions.dates import QueryError
from noteql.functions.text import tokenize
from noteql.operators import fts
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from noteql.operators.clusters import Clustered

RELATED_THRESHOLD = 0.3
FUSED_THRESHOLD = 0.3
TEXT_WEIGHT, VECTOR_WEIGHT = 0.7, 0.5

#: Text to vector; the default hashes tokens, as no model weights are at hand.
Embedder = Callable[[str], list[float]]


def hashing_embedder(dim: int = 384) -> Embedder:
    def embed(text: str) -> list[float]:
        out = np.zeros(dim)
        for w in tokenize(text):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[h % dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out)
        return (out / norm if norm else out).tolist()

    return embed


def embed_notes(notes: DataFrame, text: Column, embedder: Embedder, model: str, indexed_at: Column) -> DataFrame:
    """(note_id, vector, model, indexed_at), embedded in Arrow batches."""

    @F.pandas_udf("array<float>")
    def embedded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(x) for x in embedder(t or "")])

    return notes.select("note_id", embedded(text).alias("vector"), F.lit(model).alias("model"), indexed_at.alias("indexed_at"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """The vector at unit length; raises on one of no length."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 1e-12, n).otherwise(F.raise_error("cannot normalise a vector of no length").cast("double")))


def similarity(v: Column, query: list[float]) -> Column:
    """max(cosine, 0) with a constant query vector; 0 for a vector of no length."""
    q = np.array(query, float)
    size = float(np.linalg.norm(q))
    literal = F.array(*[F.lit(float(x)) for x in q])
    n = norm(v) * size
    return F.when(n > 0, F.greatest(dot(v, literal) / n, F.lit(0.0))).otherwise(F.lit(0.0))


def knn(vectors: DataFrame | Clustered, query: list[float], k: int, notes: DataFrame | None = None, threshold: float = 0.0, model: str | None = None) -> DataFrame:
    """(note_id, similarity) of the k nearest vectors, of one model if it is named; ids without a note row are dropped after the look-up, so fewer
    may come back. Vectors kept by cluster (``clusters.Clustered``, of one model) give the same from those clusters alone that can
    hold a neighbour."""
    if not isinstance(vectors, DataFrame):
        near = vectors.nearest(query, k)
        if notes is not None:
            near = near.join(notes.select("note_id"), "note_id", "left_semi")
        return near.where(F.col("similarity") >= threshold)
    vectors = vectors if model is None else vectors.where(F.col("model") == model)
    near = vectors.select("note_id", similarity(F.col("vector"), query).alias("similarity")).orderBy(F.col("similarity").desc(), "note_id").limit(k)
    if notes is not None:
        near = near.join(notes.select("note_id"), "note_id", "left_semi")
    return near.where(F.col("similarity") >= threshold)


def of_note(vectors: DataFrame, note_id, model: str | None = None) -> DataFrame:
    """A note's stored vectors, of one model or of all."""
    rows = vectors.where(F.col("note_id") == note_id)
    return rows if model is None else rows.where(F.col("model") == model)


def vector_of(vectors: DataFrame, note_id, model: str | None = None) -> list[float] | None:
    """One stored vector, to the driver."""
    found = of_note(vectors, note_id, model).select("vector").limit(1).collect()
    return None if not found else [float(x) for x in found[0].vector]


def related(vectors: DataFrame | Clustered, anchor, limit: int, notes: DataFrame | None = None, threshold: float = RELATED_THRESHOLD, of: DataFrame | None = None) -> DataFrame:
    """Notes near a stored note, itself left out: twice the limit is looked up first. ``of`` has the vectors by note, if
    they are not in ``vectors``."""
    rows = of if of is not None else vectors if isinstance(vectors, DataFrame) else vectors.read(None)
    query = vector_of(rows, anchor)
    if query is None:
        raise QueryError(f"note {anchor!r} has no vector")
    near = knn(vectors, query, 2 * limit, notes, threshold).where(F.col("note_id") != anchor)
    return near.orderBy(F.col("similarity").desc(), "note_id").limit(limit)


def semantic_search(indexed: DataFrame | fts.Kept, vectors: DataFrame | Clustered, query: list[float], limit: int, filters=None, excludes=(), metadata_dates=None, stem: bool = False) -> DataFrame:
    """Nearest notes; filters and exclusions come after twice the limit is looked up, so fewer may come back."""
    near = knn(vectors, query, 2 * limit)
    kept = fts.passing(indexed, filters or {}, list(excludes), metadata_dates, stem)
    near = near.join(kept.select("note_id"), "note_id", "left_semi")
    return near.orderBy(F.col("similarity").desc(), "note_id").limit(limit)


def fuse(text_hits: DataFrame, vector_hits: DataFrame, limit: int) -> DataFrame:
    """Full outer join of (note_id, score) and (note_id, similarity): 0.7 * score + 0.5 * similarity. A note that only
    the text found stays whatever it scores; one with a similarity over 0 needs 0.3 in all, and so does one that only
    the vectors found."""
    both = text_hits.select("note_id", F.col("score").alias("f")).join(vector_hits.select("note_id", F.col("similarity").alias("s")), "note_id", "full")
    total = TEXT_WEIGHT * F.coalesce("f", F.lit(0.0)) + VECTOR_WEIGHT * F.coalesce("s", F.lit(0.0))
    weak = (total < FUSED_THRESHOLD) & ((F.coalesce("s", F.lit(0.0)) > 0) | F.col("f").isNull())
    reason = F.when(F.col("f").isNull(), "Semantic match").when(F.coalesce("s", F.lit(0.0)) > 0, "Full-text and semantic match").otherwise("Full-text match")
    kept = both.withColumn("score", total).withColumn("reason", reason).where(~weak)
    return kept.orderBy(F.col("score").desc(), "note_id").limit(limit).select("note_id", "score", "reason", "f", "s")


def hybrid_search(indexed: DataFrame | fts.Kept, vectors: DataFrame | Clustered, query: str, embedder: Embedder, limit: int, now=None, metadata_dates=None, stem: bool = False) -> DataFrame:
    """Both searches at three times the limit, fused."""
    from noteql.plans.query import clean_for_embedding, parse

    q = parse(query, now)
    text_hits = fts.search(indexed, q, 3 * limit, now, metadata_dates, stem)
    near = knn(vectors, embedder(clean_for_embedding(query)), 3 * limit)
    kept = fts.passing(indexed, q.filters, q.excludes, metadata_dates, stem)
    return fuse(text_hits, near.join(kept.select("note_id"), "note_id", "left_semi"), limit)


def related_notes(strategy: str, anchor, limit: int, notes: DataFrame, edges: DataFrame, indexed: DataFrame | fts.Kept | None = None, vectors: DataFrame | Clustered | None = None, embedder: Embedder | None = None, now=None, metadata_dates=None, stem: bool = False) -> DataFrame:
    """(note_id, score, reason) by one of auto, semantic, graph and hybrid.

    Semantic and hybrid search for a text made of the anchor's title, tags and first words, twice the limit, the anchor
    left out. Auto is semantic if there are vectors and an embedder; without them, or if nothing is found, the graph
    answers.
    """
    from noteql.operators.links import neighbours
    from noteql.plans.query import clean_for_embedding

    if strategy not in ("auto", "semantic", "graph", "hybrid"):
        raise QueryError(f"unknown strategy {strategy!r}")
    by_graph = neighbours(edges, anchor).select("note_id", F.lit(None).cast("double").alias("score"), F.col("reasons").alias("reason")).limit(limit)
    if strategy == "graph" or vectors is None or embedder is None or indexed is None:
        return by_graph
    tags = F.col("tags") if "tags" in notes.columns else F.array().cast("array<string>")
    row = notes.where(F.col("note_id") == anchor).select(extract.similarity_text(F.col("title"), tags, F.col("content")).alias("text")).first()
    if row is None:
        raise QueryError(f"no note is called {anchor!r}")
    if strategy == "hybrid":
        # The text is words to find, whatever the query language makes of its signs.
        literal = " ".join(tokenize(row.text)) if row.text else ""
        found = hybrid_search(indexed, vectors, literal, embedder, 2 * limit, now, metadata_dates, stem) if literal else None
    else:
        near = semantic_search(indexed, vectors, embedder(clean_for_embedding(row.text)), 2 * limit)
        found = near.select("note_id", F.col("similarity").alias("score"), F.lit("Semantic match").alias("reason"))
    if found is None:
        return by_graph
    found = found.where(F.col("note_id") != anchor).select("note_id", "score", "reason").orderBy(F.col("score").desc(), "note_id").limit(limit)
    return by_graph if found.isEmpty() else found


def stale(notes: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Notes whose vector of this model is missing or of another generation than their text."""
    have = vectors.where(F.col("model") == model).select("note_id", F.col("indexed_at").alias("vector_at"))
    return notes.join(have, "note_id", "left").where(~F.col("indexed_at").eqNullSafe(F.col("vector_at"))).select("note_id")


def collect_garbage(vectors: DataFrame, notes: DataFrame) -> DataFrame:
    """Vectors that still have a note."""
    return vectors.join(notes.select("note_id"), "note_id", "left_semi")
