"""Embedding near-dedup: a forest of random-projection trees with spill overlap, compared within leaves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, keep, table
from .components import connected_components

GOOD = (
    "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    " AND exists(embedding, x -> x <> 0)"
)
#: A leaf in which this share of all pairs are links is split no further: a split would part many of them, and to compare it whole
#: takes 1 / DENSE times as many cosines as it has links.
DENSE = 0.15


def _direction(seed: int, dims: int) -> np.ndarray:
    return np.random.default_rng(seed & 0xFFFFFFFFFFFF).standard_normal(dims)


def _children(node: np.ndarray | int):
    """Ids of the two halves of a node; ids are 63-bit and mixed, so paths of any depth have ids of their own."""
    def mix(x, side):
        x = (np.asarray(x, dtype=np.uint64) * np.uint64(2) + np.uint64(side)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) & np.uint64(0x7FFFFFFFFFFFFFFF)).astype(np.int64)

    with np.errstate(over="ignore"):
        return mix(node, 0), mix(node, 1)


def _dense(unit: np.ndarray, threshold: float) -> bool:
    """Whether the vectors (some 256 of a node's) are so near each other that the node is compared whole."""
    n = len(unit)
    return n > 1 and np.count_nonzero(unit @ unit.T >= threshold) - n >= DENSE * n * (n - 1)


def _fit(sample: np.ndarray, trees: int, depth: int, spill: float, threshold: float) -> list[dict[int, tuple[int, float, float]]]:
    """For each tree: node -> (dims, lower, upper bound of the band that goes both ways). One tree will do if its root is dense."""
    out = []
    if _dense(sample[:256], threshold):
        return [{}]
    for tree in range(trees):
        nodes, level = {}, [(tree + 1, np.arange(len(sample)))]
        for _ in range(depth):
            below = []
            for node, rows in level:
                if len(rows) < 8 or _dense(sample[rows[:256]], threshold):
                    continue
                at = sample[rows] @ _direction(node, sample.shape[1])
                lo, hi = np.quantile(at, [0.5 - spill, 0.5 + spill])
                nodes[node] = (float(lo), float(hi))
                left, right = _children(node)
                below += [(int(left), rows[at <= hi]), (int(right), rows[at >= lo])]
            level = below
        out.append(nodes)
    return out


def _as_matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _routed(classes: DataFrame, forest: list[dict], roots: int) -> DataFrame:
    """(cls, leaf) for each leaf that a vector falls into, over all trees."""
    def route(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            if not len(ids):
                continue
            unit = _unit(_as_matrix(batch.column(1).to_pylist()))
            for tree, nodes in enumerate(forest):
                open_ = [(tree + 1, np.arange(len(ids)))]
                while open_:
                    node, rows = open_.pop()
                    if not len(rows):
                        continue
                    if node not in nodes:
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(np.full(len(rows), node, np.int64))], names=["cls", "leaf"])
                        continue
                    lo, hi = nodes[node]
                    at = unit[rows] @ _direction(node, unit.shape[1])
                    left, right = _children(node)
                    open_ += [(int(left), rows[at <= hi]), (int(right), rows[at >= lo])]

    return classes.select("cls", "embedding").mapInArrow(route, "cls long, leaf long")


def _split_large(assigned: DataFrame, classes: DataFrame, cap: int, spill: float, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Split leaves of over `cap` vectors on, a level a round, at quantiles of all their vectors' projections, until those that are left
    are dense. Returns the leaves and (leaf, count) of dense ones, or None.

    Vectors of one projection are of one direction (but by a chance of zero) and always go the same ways. If they are so many that a
    split would leave a child nearly as large as its parent, their pairs alone make the leaf dense, so the rounds end."""
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "dense": [_dense(_unit(_as_matrix(list(pdf["embedding"]))), threshold)]})

    def project(batches):
        for batch in batches:
            leaf = np.asarray(batch.column(1))
            unit = _unit(_as_matrix(batch.column(2).to_pylist()))
            at = np.zeros(len(leaf))
            for node in np.unique(leaf):
                at[leaf == node] = unit[leaf == node] @ _direction(int(node), unit.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at)], names=["cls", "leaf", "at"])

    def halves(batches):
        for batch in batches:
            left, right = _children(np.asarray(batch.column(1)))
            at, lo, hi = (np.asarray(batch.column(i)) for i in (2, 3, 4))
            ids = np.asarray(batch.column(0))
            to_left, to_right = at <= hi, at >= lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[to_left], ids[to_right]])), pa.array(np.concatenate([left[to_left], right[to_right]]))], names=["cls", "leaf"]
            )

    whole = None
    while True:
        large = assigned.groupBy("leaf").count().filter(F.col("count") > cap)
        large = keep(large if whole is None else large.join(whole, "leaf", "left_anti"), "large-leaves")
        if large.isEmpty():
            return assigned, whole
        some = assigned.join(large, "leaf").filter(F.pmod(F.xxhash64("cls", "leaf"), F.ceil(F.col("count") / 256)) == 0)
        judged = keep(some.join(classes, "cls").select("leaf", "embedding").groupBy("leaf").applyInPandas(judge, "leaf long, dense boolean"), "judged-leaves")
        dense = large.join(judged.filter("dense"), "leaf", "left_semi")
        whole = keep(dense if whole is None else whole.union(dense), "dense-leaves")
        large = keep(large.join(whole, "leaf", "left_anti").select("leaf"), "leaves-to-split")
        if large.isEmpty():
            return assigned, whole
        rows = assigned.join(large, "leaf").join(classes, "cls").select("cls", "leaf", "embedding")
        at = keep(rows.mapInArrow(project, "cls long, leaf long, at double"), "projections")
        bands = at.groupBy("leaf").agg(F.percentile_approx("at", [0.5 - spill, 0.5 + spill], 1000).alias("b"))
        bands = bands.select("leaf", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))
        below = at.join(bands, "leaf").select("cls", "leaf", "at", "lo", "hi").mapInArrow(halves, "cls long, leaf long")
        now = keep(assigned.join(large, "leaf", "left_anti").select("cls", "leaf").union(below), "leaves")
        drop_kept(assigned, at)
        assigned = now


def _forest_edges(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in a boolean matrix."""
    edges, unseen = [], np.ones(len(near), bool)
    for start in range(len(near)):
        if not unseen[start]:
            continue
        unseen[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            found = np.flatnonzero(near[i] & unseen)
            unseen[found] = False
            edges += [(i, int(j)) for j in found]
            stack += found.tolist()
    return edges


def near_vectors(rows: DataFrame, threshold: float = 0.9, trees: int = 12, leaf: int = 1000, spill: float = 0.05, sample: int = 20000) -> DataFrame:
    """Link vectors of cosine >= `threshold` found in a common leaf: vec_id, n_links, component_id, kept.

    Equal vectors first become one class, so copies are never compared with each other. Each of `trees` trees halves the classes at
    the median of a random projection; the share `spill` on either side of the median goes both ways. The upper levels are fitted on
    at most `sample` vectors (taken by hash; every vector is routed), and a leaf that still holds over 3 x `leaf` vectors is split on
    at quantiles of all its vectors, unless a share DENSE of its pairs are links: such a leaf is compared whole, part against part in tasks
    of their own. Within a leaf all cosines are computed in blocks of double precision, and a pair counts in the
    first leaf that holds both, so no pair is listed and links are counted once; what leaves a task is a count for each vector and a
    spanning forest. n_links counts rows: every copy of a linked vector is one link.
    Vectors that are null, zero, or hold null or non-finite components link with nothing; so do vectors of different lengths. Rows
    without vec_id come back with n_links 0, a null component_id and kept false. An empty table gives an empty result.
    """
    rows = rows.select("vec_id", "embedding")
    good = rows.filter("vec_id IS NOT NULL").filter(GOOD)
    classes = keep(good.groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies")), "vector-classes")
    stats = classes.groupBy(F.size("embedding").alias("dims")).count().collect()  # one row for each length of vector
    # one vec_id may stand for several vectors: classes are told apart by a number of their own
    numbered = keep(classes.withColumn("rep", F.col("cls")).withColumn("cls", F.xxhash64("embedding")), "vector-classes")
    drop_kept(classes)
    classes = numbered
    links, edges = None, None
    for dims, n in ((r["dims"], r["count"]) for r in stats):
        own = classes.filter(F.size("embedding") == dims)
        depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        fitted = own.select("cls", "embedding").orderBy(F.xxhash64("cls")).limit(sample).collect() if depth else []
        depth = min(depth, int(np.log2(max(1, len(fitted) / 20))))
        forest = _fit(_unit(_as_matrix([r["embedding"] for r in fitted])), trees, depth, spill, threshold) if depth else [{}] * (trees if n > 3 * leaf else 1)
        assigned = keep(_routed(own, forest, trees), "leaves")
        assigned, whole = _split_large(assigned, own.select("cls", "embedding"), 3 * leaf, spill, threshold)
        paths = assigned.groupBy("cls").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))  # bounded by trees and spill
        full = paths.join(own, "cls").withColumn("leaf", F.explode("leaves")).select("leaf", "cls", "copies", "embedding", "leaves")
        full = full.withColumns({"a": F.lit(0), "b": F.lit(0), "side": F.lit(False)})
        if whole is not None:  # each pair of a dense leaf's parts is a task, which holds as many rows as another leaf may
            parts = whole.select("leaf", F.ceil(F.col("count") * 2 / (3 * leaf)).cast("int").alias("parts"))
            part = F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1))).cast("int")
            pairs = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda x: F.struct(F.least(x, part).alias("a"), F.greatest(x, part).alias("b"), (part > x).alias("side")))
            full = full.drop("a", "b", "side").join(parts, "leaf", "left").withColumn("p", F.explode(pairs)).select("leaf", "cls", "copies", "embedding", "leaves", "p.a", "p.b", "p.side")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, copies, here = pdf["cls"].to_numpy(), pdf["copies"].to_numpy(), int(pdf["leaf"].iloc[0])
            unit = _unit(_as_matrix(list(pdf["embedding"])))
            near = np.zeros((len(ids), len(ids)), bool)
            for i in range(0, len(ids), 1024):
                near[i : i + 1024] = unit[i : i + 1024] @ unit.T >= threshold
            if (pdf["a"] != pdf["b"]).any():
                side = pdf["side"].to_numpy()
                near &= side[:, None] != side[None, :]
            np.fill_diagonal(near, False)
            near &= near.T
            busy = np.flatnonzero(near.any(axis=1))
            if not len(busy):
                return pd.DataFrame({"cls": [], "other": [], "n": []}, dtype="int64")
            near, ids, copies = near[np.ix_(busy, busy)], ids[busy], copies[busy]
            earlier = [[x for x in leaves if x < here] for leaves in pdf["leaves"].iloc[busy]]
            names = {x: i for i, x in enumerate(sorted({x for xs in earlier for x in xs}))}
            member = np.zeros((len(ids), max(1, len(names))), np.float32)
            for i, xs in enumerate(earlier):
                member[i, [names[x] for x in xs]] = 1
            first = near & ~(member @ member.T > 0)
            counts = first @ copies
            edges = np.array(_forest_edges(first), np.int64).reshape(-1, 2)
            some = np.flatnonzero(counts)
            return pd.DataFrame(
                {"cls": np.concatenate([ids[some], ids[edges[:, 0]]]), "other": np.concatenate([ids[some], ids[edges[:, 1]]]), "n": np.concatenate([counts[some], np.zeros(len(edges), np.int64)])}
            )

        found = keep(full.groupBy("leaf", "a", "b").applyInPandas(compare, "cls long, other long, n long"), "leaf-links")
        drop_kept(assigned)
        links = found if links is None else links.union(found)
    out = rows.withColumn("cls", F.when(F.col("vec_id").isNotNull() & F.expr(GOOD), F.xxhash64("embedding")))
    if links is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counted = links.filter("n > 0").groupBy("cls").agg(F.sum("n").alias("n"))
    roots = connected_components(links.filter("n = 0").select(F.col("cls").alias("src"), F.col("other").alias("dst")))
    known = classes.select("cls", "copies", "rep").join(counted, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    known = keep(known.select("cls", "copies", "rep", "n", F.coalesce("root", "cls").alias("root")), "classes")
    smallest = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = known.join(smallest, "root").select("cls", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "component_id")
    out = out.join(known, "cls", "left")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embedding_near_dedup": op7_embedding_near_dedup}
#: Brute force: all pairs, as the operator's recall is meant to be whole at this size; the method itself is not SQL.
ORACLE: dict[str, str] = {}
