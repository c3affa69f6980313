"""Exact top-k search: term-at-a-time accumulation of sparse queries over blocks of postings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def _postings(rows: list) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """term -> (rows that hold it, their weights); a term that every row holds has a slice for rows."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    terms = np.concatenate([np.arange(len(r)) for r in rows]) if n else np.zeros(0, int)
    weights = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if n else np.zeros(0, np.int64)
    some = weights != 0
    at, terms, weights = at[some], terms[some], weights[some]
    order = np.argsort(terms, kind="stable")
    at, terms, weights = at[order], terms[order], weights[order]
    names, first = np.unique(terms, return_index=True)
    ends = [*first[1:], len(terms)]
    return {int(t): (slice(None) if j - i == n else at[i:j], weights[i:j]) for t, i, j in zip(names, first, ends)}


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank (from 1), vec_id, score.

    `rows` and `queries` hold (vec_id, terms: array<bigint>, one weight for each dimension; zeros are not scored). Every query meets
    every row with another vec_id. Blocks are dealt by hash and of about `block` and `query_block` rows; each pair of blocks is one
    small task, in which a query's terms scatter weighted postings into one dense score array, whose best k are selected; the partial
    lists (k for each query and block) are merged by a window. Ties go to the smaller vec_id. Rows without vec_id or terms take no
    part; a repeated row is returned as often as it stands there; equal queries count once, and queries of one vec_id with other terms
    each have k rows. Of rows of different lengths the shorter counts as having zeros further on; scores must fit in 64 bits. No queries
    or no rows give an empty result.
    """
    rows = rows.select("vec_id", "terms").filter("vec_id IS NOT NULL AND terms IS NOT NULL")
    queries = queries.select("vec_id", "terms").filter("vec_id IS NOT NULL AND terms IS NOT NULL").dropDuplicates(["vec_id", "terms"])
    n, q = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-q // query_block))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "terms"), F.lit(own_n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
        )

    def best(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        ids = block["vec_id"].to_numpy()
        postings = _postings(list(block["terms"]))
        out = []
        for query_id, terms, asked_by in zip(asked["vec_id"], asked["terms"], asked["q"]):
            if not len(ids):
                break
            score = np.zeros(len(ids), np.int64)
            for term in np.flatnonzero(np.asarray(terms)):
                if found := postings.get(int(term)):
                    score[found[0]] += int(terms[term]) * found[1]
            open_ = np.flatnonzero(ids != query_id)
            if len(open_) > k:
                least = np.partition(score[open_], len(open_) - k)[len(open_) - k]
                open_ = open_[score[open_] >= least]
            open_ = open_[np.lexsort((ids[open_], -score[open_]))][:k]
            out.append(pd.DataFrame({"query_id": query_id, "q": asked_by, "vec_id": ids[open_], "score": score[open_]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []}, dtype="int64")

    asked = dealt(queries.withColumn("q", F.xxhash64("terms")), "qb", query_blocks, "cb", blocks).groupBy("qb", "cb")
    held = dealt(rows, "cb", blocks, "qb", query_blocks).groupBy("qb", "cb")
    partial = asked.cogroup(held).applyInPandas(best, "query_id long, q long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, terms) with each component as floor(1024 x); vectors that are null or hold null or non-finite components are left out."""
    good = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    return embeddings.filter(good).selectExpr("vec_id", "transform(embedding, x -> cast(floor(1024 * cast(x AS double)) AS bigint)) AS terms")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


QUERIES = {"op2_exact_topk": op2_exact_topk}
ORACLE = {
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
}
