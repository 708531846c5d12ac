"""Retrieval for batches of questions: vector and lexical top-k, rank fusion, modifiers, confidence, collapse.

Questions come as a DataFrame, and every window is partitioned by question. Vectors and terms are compared exactly: each
block of questions meets each slice of the rows in a task of its own, which keeps the k best of its rows per question;
only these go on. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strataloom.functions.text import content_terms, terms

#: Questions and rows that meet in one task. Rows are sent once per block of questions, questions once per slice of rows.
QUESTION_BLOCK, SLICE_ROWS = 32_768, 65_536
#: The fusion constant, candidates per list, terms per question.
RRF_K, POOL, MOST_TERMS = 60, 50, 16
#: Words below which a text is short, confidence thresholds.
SHORT_WORDS, LONG_WORDS = 30, 100
HIGH_SIMILARITY, MEDIUM_SIMILARITY = 0.62, 0.45
LOW_SCORE, HIGH_SCORE, SEPARATION = 0.012, 0.020, 0.004
#: Recency decay and what is exempt from it.
DECAY_FLOOR, DECAY_DOMAINS, DURABLE = 0.25, ("K8s", "Network", "Security"), "durable"


def _unit(vectors: pa.ChunkedArray, n: int) -> np.ndarray:
    v = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _block_top(k: int, same: bool):
    def run(key: tuple[pa.Scalar, ...], questions: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")  # ties to the smaller id
        asked, ids = questions.column("qid"), rows.column("id")
        found = []
        if questions.num_rows and rows.num_rows:
            unit, v = _unit(questions.column("asked"), len(asked)), _unit(rows.column("vector"), len(ids))
            q_names, names = np.array(asked.to_pylist(), dtype=object), np.array(ids.to_pylist(), dtype=object)
            keep = min(k, len(ids))
            for at in range(0, len(unit), 256):
                sim = unit[at : at + 256] @ v.T
                if same:
                    sim[q_names[at : at + 256, None] == names[None, :]] = -np.inf
                best = np.argsort(-np.round(sim, 12), axis=1, kind="stable")[:, :keep]
                value = np.take_along_axis(sim, best, axis=1).ravel()
                good = np.isfinite(value)
                found.append((at + np.repeat(np.arange(len(sim)), keep)[good], best.ravel()[good], value[good]))
        q, r, value = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"qid": asked.take(pa.array(q)), "id": ids.take(pa.array(r)), "similarity": pa.array(value)})

    return run


def _first(rows: DataFrame, order: WindowSpec, k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each partition with their place from 0; in this form each task cuts its own rows
    to ``k`` before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).withColumn(name, F.col("_n") - 1).drop("_n")


def _met(asked: DataFrame, held: DataFrame, run: Callable, value: str, n_asked: int, n_held: int) -> DataFrame:
    """``qid, id, <value>``: what ``run`` finds where a block of questions (``qid`` and more) meets a slice of rows (``id`` and more)."""
    blocks = max(1, -(-n_asked // QUESTION_BLOCK))
    slices = max(-(-n_held // SLICE_ROWS), -(-asked.sparkSession.sparkContext.defaultParallelism // blocks))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("block", of("qid", blocks)).withColumn("slice", every(slices))
    held = held.withColumn("slice", of("id", slices)).withColumn("block", every(blocks))
    kinds = dict(asked.dtypes)["qid"], dict(held.dtypes)["id"]
    return asked.groupBy("block", "slice").cogroup(held.groupBy("block", "slice")).applyInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, {value} double")


def vector_top(questions: DataFrame, rows: DataFrame, k: int = POOL, exclude_self: bool = False) -> DataFrame:
    """For each question (``qid, embedding``) its ``k`` most similar rows (``id, embedding``), exactly.

    Columns ``qid, id, similarity, vector_rank`` (from 0; ties to the smaller id). Vectors on either side must be
    usable (see functions.vectors.usable). ``exclude_self`` leaves out a row whose id is the question's.
    """
    asked = questions.select(F.col("qid").alias("qid"), F.col("embedding").alias("asked"))
    held = rows.select(F.col("id").alias("id"), F.col("embedding").alias("vector"))
    found = _met(asked, held, _block_top(k, exclude_self), "similarity", questions.count(), rows.count())
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 12)), "id")
    return _first(found, best, k, "vector_rank")


def _codes(lists: pa.ChunkedArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes of the terms of ``vocabulary`` in lists of terms."""
    lists = lists.combine_chunks()
    code = pc.index_in(lists.flatten(), value_set=vocabulary)
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[known]
    return row.astype(np.int64), code.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)


def _block_lexical(k: int, same: bool):
    def run(key: tuple[pa.Scalar, ...], questions: pa.Table, rows: pa.Table) -> pa.Table:
        asked, ids = questions.column("qid").combine_chunks(), rows.column("id").combine_chunks()
        names = ids.unique()
        names = names.take(pc.sort_indices(names))  # ties to the smaller id
        found = []
        if len(asked) and len(names):
            vocabulary = questions.column("wanted").combine_chunks().flatten().unique()
            row, code = _codes(rows.column("held"), vocabulary)
            place = pc.index_in(ids, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            posted, tf = np.unique(code * len(names) + place[row], return_counts=True)
            at, weight = posted % len(names), tf / (tf + 1.2)
            start = np.searchsorted(posted // len(names), np.arange(len(vocabulary) + 1))
            q_row, wanted = _codes(questions.column("wanted"), vocabulary)
            q_start = np.searchsorted(q_row, np.arange(len(asked) + 1))
            own = pc.index_in(asked, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False) if same else np.full(len(asked), -1)
            score = np.zeros(len(names))
            for q in range(len(asked)):
                score[:] = 0
                for t in wanted[q_start[q] : q_start[q + 1]]:
                    hit = slice(start[t], start[t + 1])
                    score[at[hit]] += weight[hit]  # a row is there once per term
                if own[q] >= 0:
                    score[own[q]] = 0
                met = np.flatnonzero(score)
                value = np.round(score[met], 9)
                if len(met) > k:
                    good = value >= np.partition(value, -k)[-k]
                    met, value = met[good], value[good]
                best = np.argsort(-value, kind="stable")[:k]
                found.append((np.full(len(best), q), met[best], value[best]))
        q, r, value = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"qid": asked.take(pa.array(q)), "id": names.take(pa.array(r)), "lexical_score": pa.array(value)})

    return run


def question_terms(questions: DataFrame, text: str = "question", analyze: Callable[[str], Column] = content_terms) -> DataFrame:
    """``qid, wanted``: what the analysis leaves of the first 16 terms of each question, stop words and repeats counted among
    these; questions of which nothing is left are left out."""
    first = F.array_join(F.slice(terms(text), 1, MOST_TERMS), " ")
    return questions.select(F.col("qid").alias("qid"), F.array_distinct(analyze(first)).alias("wanted")).filter(F.size("wanted") > 0)


def lexical_top(questions: DataFrame, rows: DataFrame, k: int = POOL, exclude_self: bool = False, analyze: Callable[[str], Column] = content_terms) -> DataFrame:
    """For each question (``qid, question``) the ``k`` rows (``id, content``) with the greatest term score, exactly.

    The score is ours: the sum over matched terms of tf / (tf + 1.2), term saturation without length or idf. Columns
    ``qid, id, lexical_score, lexical_rank`` (from 0; ties to the smaller id). Texts without terms and questions without
    any find nothing; rows of one id count as one. Each slice of the rows is turned into postings in its task, so a term
    that many rows share is never a key that is shuffled. ``analyze`` gives the terms of a text
    (functions.analyzer.stems folds English inflections).
    """
    asked = question_terms(questions, analyze=analyze)
    held = rows.select(F.col("id").alias("id"), analyze("content").alias("held")).filter(F.size("held") > 0)
    found = _met(asked, held, _block_lexical(k, exclude_self), "lexical_score", questions.count(), rows.count())
    best = Window.partitionBy("qid").orderBy(F.desc("lexical_score"), "id")
    return _first(found, best, k, "lexical_rank")


def fuse(vector: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists by union and one aggregation."""
    none = lambda t: F.lit(None).cast(t)
    both = vector.select("qid", "id", "vector_rank", "similarity", none("int").alias("lexical_rank"), none("double").alias("lexical_score")).unionByName(
        lexical.select("qid", "id", none("int").alias("vector_rank"), none("double").alias("similarity"), "lexical_rank", "lexical_score")
    )
    one = lambda r: F.coalesce(F.lit(1.0) / (k + 1 + F.max(r)), F.lit(0.0))
    return both.groupBy("qid", "id").agg(
        *[F.max(c).alias(c) for c in ("vector_rank", "similarity", "lexical_rank", "lexical_score")],
        F.round(one("vector_rank") + one("lexical_rank"), 12).alias("rrf_score"),
        (F.max("vector_rank").isNotNull().cast("int") + F.max("lexical_rank").isNotNull().cast("int")).alias("retrievers_hit"),
    )


def length_penalty(word_count: Column, chunked: Column) -> Column:
    """Texts below 30 words lose in proportion; sections don't."""
    return F.when(~chunked & (word_count < SHORT_WORDS), word_count / F.lit(float(SHORT_WORDS))).otherwise(1.0)


def component_boost(status: Column, component: Column, boost: float) -> Column:
    return F.when((status == "current") & component, F.lit(boost)).otherwise(1.0)


def recency_decay(created_at: Column, domain: Column, tags: Column, component: Column, now: Column, half_life_days: float) -> Column:
    """max(floor, 0.5 ^ (age / half-life)) in some domains; durable rows, components and unknown ages are exempt."""
    if not half_life_days:
        return F.lit(1.0)
    age = F.greatest((F.unix_seconds(now) - F.unix_seconds(created_at)) / 86400.0, F.lit(0.0))
    exempt = component | F.coalesce(F.array_contains(tags, DURABLE), F.lit(False)) | created_at.isNull() | ~F.coalesce(domain.isin(*DECAY_DOMAINS), F.lit(False))
    return F.when(exempt, 1.0).otherwise(F.greatest(F.lit(DECAY_FLOOR), F.pow(F.lit(0.5), age / half_life_days)))


def confidence(similarity: Column, score: Column, neighbour: Column, words: Column, agree: Column, chunked: Column) -> Column:
    """``high``, ``medium`` or ``low``: by similarity where there is one, else by score and its lead."""
    by_similarity = F.when((similarity >= HIGH_SIMILARITY) & ((words >= LONG_WORDS) | agree), "high").when(similarity >= MEDIUM_SIMILARITY, "medium").otherwise("low")
    lead = F.coalesce(score - neighbour, score)
    by_score = (
        F.when((words < SHORT_WORDS) | (score < LOW_SCORE), "low")
        .when((score >= HIGH_SCORE) & (lead >= SEPARATION) & (words >= LONG_WORDS), "high")
        .otherwise("medium")
    )
    return F.when(~chunked & (words < SHORT_WORDS), "low").when(similarity.isNull(), by_score).otherwise(by_similarity)


def rank(fused: DataFrame, rows: DataFrame, now: Column, boost: float = 1.0, half_life_days: float = 0.0, floor: float | None = None, pool: int = POOL) -> DataFrame:
    """Modifiers in their order, the final order, suppression below ``floor``, and a confidence per hit.

    ``rows``: ``id, status, domain, tags, component_key, created_at, word_count, document_id``. A hit without
    vector similarity is never suppressed. Ties keep lexical hits first, then the vector order.
    """
    hits = fused.join(rows, "id")
    component = F.col("component_key").isNotNull() | F.coalesce(F.exists("tags", lambda t: t.startswith("component:")), F.lit(False))
    chunked = F.col("document_id").isNotNull()
    hits = hits.withColumns(
        {
            "length_penalty": length_penalty(F.col("word_count"), chunked),
            "component_boost": component_boost(F.col("status"), component, boost),
            "recency_decay": recency_decay(F.col("created_at"), F.col("domain"), F.col("tags"), component, now, half_life_days),
        }
    )
    hits = hits.withColumn("final_score", F.round(F.col("rrf_score") * F.col("length_penalty") * F.col("component_boost") * F.col("recency_decay"), 12))
    if floor is not None:
        hits = hits.filter(F.col("similarity").isNull() | (F.col("similarity") >= floor))
    order = Window.partitionBy("qid").orderBy(F.desc("final_score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank"), "id")
    hits = _first(hits, order, pool, "place")
    neighbour = F.when(F.col("place") <= 1, F.lead("final_score").over(Window.partitionBy("qid").orderBy("place")))
    agree = F.coalesce((F.col("lexical_rank") == 0) & (F.col("vector_rank") == 0), F.lit(False))
    return hits.withColumn("confidence", confidence(F.col("similarity"), F.col("final_score"), neighbour, F.col("word_count"), agree, chunked))


def collapse(hits: DataFrame, n: int) -> DataFrame:
    """Best section per document with its siblings' ids; the first ``n`` documents of each question."""
    hits = hits.withColumn("_doc", F.coalesce("document_id", "id"))
    by_doc = Window.partitionBy("qid", "_doc").orderBy("place")
    hits = hits.withColumn("_at", F.row_number().over(by_doc))
    others = F.collect_list(F.struct("place", "id")).over(Window.partitionBy("qid", "_doc"))  # at most the pool of a question
    hits = hits.withColumn("siblings", F.transform(F.array_sort(others), lambda x: x["id"])).filter("_at = 1")
    hits = hits.withColumn("siblings", F.array_remove("siblings", F.col("id")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("place")) - 1
    return hits.withColumn("final_place", place).filter(F.col("final_place") < n).drop("_doc", "_at")
