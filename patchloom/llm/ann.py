"""Operator 10, approximate nearest neighbours: inverted lists with an adaptive scan of the dimensions.

Centroids come from a bounded sample; every vector is filed under its nearest one, and a query visits the lists of its
nearest centroids. Vectors are turned by a random rotation, so that the first columns estimate the whole distance. A list
is scanned by blocks of columns: after each, a hypothesis test drops the candidates whose partial distance already shows that they
are farther than the fifth best so far. The survivors are scored exactly, in double precision, on the original vectors.

Lists are cut into blocks of bounded size and so are the queries of a list, so one crowded list, or one vector that is
repeated many times, becomes many tasks.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of one length are
compared with each other only, as the cosine of two lengths is not defined, and every length is searched; a query meets every
candidate row but its own vec_id; ties go to the smaller vec_id; a query visits more lists until those hold more than TOP rows, so
with fewer than TOP candidates all are returned; very large and very small components are scaled by powers of two first; a null
vec_id is neither query nor candidate; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, table

TOP = 5
QUERY_EVERY = 50
#: Rows that centroids are fitted on at most, lists at most, and the share of the lists that a query visits.
SAMPLE, MAX_LISTS, PROBED = 16_384, 4_096, 0.65
ROUNDS = 8
#: Candidates and queries of one scan at most, on average.
BLOCK, QUERY_BLOCK = 2_048, 1_024
#: Columns of one block, and how many standard errors the hypothesis test allows.
COLUMNS, SLACK = 16, 2.1
_SEED = 20240607

_MATCH = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means on unit vectors, from a fixed start."""
    rng = np.random.default_rng(_SEED)
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        nearest = np.concatenate([np.argmax(sample[a : a + 2048] @ centroids.T, axis=1) for a in range(0, len(sample), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def rotation(dimensions: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors with their largest component between 1/2 and 1: a power of two is taken out, which loses no bit that counts."""
    exponent = np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1]
    return np.ldexp(v, -exponent)


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def exact_cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of one vector with many; sums are exact to the last bit, so equal vectors tie wherever they are met."""
    q, c = scaled(q), scaled(c)
    norm = math.sqrt(math.fsum(q * q))
    return np.array([math.fsum(q * x) / (norm * math.sqrt(math.fsum(x * x))) for x in c])


def scan(turned_q: np.ndarray, own: np.ndarray, turned: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) positions among which every query's top nearest of the block are, with high probability.

    All queries of the block move through the column blocks together. While many pairs are open, a block of columns is
    added for all of them by one product; once few are, for those alone.
    """
    d, few = turned.shape[1], 0.05
    first = turned[: 8 * top]
    start = 2.0 - 2.0 * turned_q @ first.T
    start[own[:, None] == ids[None, : len(first)]] = np.inf
    bound = np.partition(start, top - 1, axis=1)[:, top - 1] if len(first) > top else np.full(len(own), np.inf)
    partial = np.zeros((len(own), len(ids)))
    partial[own[:, None] == ids[None, :]] = np.inf
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    open_sum = np.zeros(0)
    for at in range(0, d, COLUMNS):
        end = min(d, at + COLUMNS)
        q, c = turned_q[:, at:end], turned[:, at:end]
        # under the hypothesis that a candidate is no farther than the bound, its partial distance stays below this
        limit = (bound * (end / d) * (1 + SLACK / math.sqrt(end)) ** 2 if end < d else bound) + 1e-9
        if pairs is None:
            partial += (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (q @ c.T)
            keep = (partial <= limit[:, None]) & np.isfinite(partial)
            if end == d or keep.mean() < few:
                pairs = np.nonzero(keep)
                open_sum = partial[pairs]
        else:
            open_sum = open_sum + ((q[pairs[0]] - c[pairs[1]]) ** 2).sum(axis=1)
            keep = open_sum <= limit[pairs[0]]
            pairs, open_sum = (pairs[0][keep], pairs[1][keep]), open_sum[keep]
    order = np.lexsort((open_sum, pairs[0]))
    qs, cs, dist = pairs[0][order], pairs[1][order], open_sum[order]
    starts = np.searchsorted(qs, np.arange(len(own)))
    last = np.minimum(starts + top - 1, np.searchsorted(qs, np.arange(len(own)), "right") - 1)
    near = dist <= (dist[np.maximum(last, 0)] if len(dist) else np.zeros(len(own)))[qs] + 1e-9
    return qs[near], cs[near]


def _scan_block(candidates: pd.DataFrame, queries: pd.DataFrame, top: int) -> pd.DataFrame:
    """The top best of a block for each of its queries, by exact scores."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(candidates) and len(queries):
        candidates = candidates.sort_values("vec_id")
        ids, vectors = candidates["vec_id"].to_numpy(), np.stack(candidates["v"].to_numpy())
        own, asked = queries["query_id"].to_numpy(), np.stack(queries["query"].to_numpy())
        turn = rotation(vectors.shape[1])
        qs, cs = scan(unit(asked) @ turn, own, unit(vectors) @ turn, ids, top)
        for i in np.unique(qs):
            met = cs[np.searchsorted(qs, i) : np.searchsorted(qs, i, "right")]
            # equal vectors are scored once; many of them may tie, and the smallest ids win
            distinct, place = np.unique(vectors[met], axis=0, return_inverse=True)
            scores = exact_cosine(asked[i], distinct)[place.ravel()]
            best = np.lexsort((ids[met], -scores))[:top]
            out["query_id"] += [own[i]] * len(best)
            out["vec_id"] += ids[met[best]].tolist()
            out["score"] += scores[best].tolist()
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


class Spaces:
    """Centroids of each length of vectors in the sample, with the number of the first list of each.

    A length that the sample lacks has one list, numbered by the length with a minus sign.
    """

    def __init__(self, sample: list[list[float]], total: int) -> None:
        by_length: dict[int, list[list[float]]] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        self.of: dict[int, tuple[int, np.ndarray]] = {}
        first = 0
        for length in sorted(by_length):
            rows = unit(np.array(by_length[length]))
            lists = max(1, min(MAX_LISTS, round(math.sqrt(total * len(rows) / len(sample))), len(rows)))
            self.of[length] = first, fit_centroids(rows, lists)
            first += lists

    def nearness(self, vectors: np.ndarray) -> tuple[int, np.ndarray]:
        """First list of the vectors' length, and how near each vector is to the lists from there on."""
        length = vectors.shape[1]
        if length not in self.of:
            return -length, np.zeros((len(vectors), 1))
        first, centroids = self.of[length]
        return first, unit(vectors) @ centroids.T


def _by_length(f: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows of one length."""
    for _, part in f.groupby(f["v"].map(len), sort=True):
        yield part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy())


def search(spark: SparkSession, vectors: DataFrame, every: int = QUERY_EVERY, top: int = TOP, probed: float = PROBED) -> DataFrame:
    """query_id, rank, vec_id, score."""
    scratch = Scratch(spark, "ann")
    rows = scratch.save(usable(vectors), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a sample by hash, so that it does not depend on how rows are dealt; its expected size is within SAMPLE
    share = min(1.0, SAMPLE / total)
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(_SEED)), F.lit(1 << 20)) < int(share * (1 << 20))).select("vec_id", "v").orderBy("vec_id").limit(SAMPLE)
    shared = spark.sparkContext.broadcast(Spaces([r["v"] for r in picked.collect()], total))

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ids, v in _by_length(f):
                first, nearness = shared.value.nearness(v)
                yield pd.DataFrame({"vec_id": ids, "v": list(v), "list": first + np.argmax(nearness, axis=1)})

    filed = scratch.save(rows.mapInPandas(file, "vec_id long, v array<double>, list int"), "filed")
    # MAX_LISTS rows for each length of vectors at most
    sizes = scratch.save(filed.groupBy("list").agg(F.count("*").alias("n")), "sizes")
    held = spark.sparkContext.broadcast({r["list"]: r["n"] for r in sizes.collect()})

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ids, v in _by_length(f):
                first, nearness = shared.value.nearness(v)
                order = np.argsort(-nearness, axis=1, kind="stable")
                counts = np.array([held.value.get(first + i, 0) for i in range(nearness.shape[1])])
                # the query itself is in one of the lists, so more than TOP rows are wanted
                enough = 1 + (np.cumsum(counts[order], axis=1) <= top).sum(axis=1)
                visited = np.minimum(np.maximum(math.ceil(nearness.shape[1] * probed), enough), nearness.shape[1])
                yield pd.DataFrame({"vec_id": ids, "v": list(v), "probes": [(first + o[:n]).tolist() for o, n in zip(order, visited, strict=True)]})

    probes = filed.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInPandas(probe, "vec_id long, v array<double>, probes array<int>")
    asked = scratch.save(probes, "probes").select("vec_id", "v", F.explode("probes").alias("list"))
    # block counts by list: MAX_LISTS rows at most
    blocks = sizes.select("list", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    asks = scratch.save(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("ask_blocks")).join(blocks, "list"), "blocks")
    by_list = F.broadcast(asks)
    salt = F.xxhash64("vec_id")
    steps = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    candidates = filed.join(by_list, "list").select("vec_id", "v", "list", F.pmod(salt, "blocks").alias("block"), steps("ask_blocks").alias("ask"))
    queries = asked.join(by_list, "list").select("vec_id", "v", "list", steps("blocks").alias("block"), F.pmod(salt, "ask_blocks").alias("ask"))
    queries = queries.toDF("query_id", "query", "q_list", "q_block", "q_ask")
    n = shuffle_partitions(spark)
    left = candidates.repartition(n, "list", "block", "ask").groupBy("list", "block", "ask")
    right = queries.repartition(n, "q_list", "q_block", "q_ask").groupBy("q_list", "q_block", "q_ask")
    met = left.cogroup(right).applyInPandas(lambda c, q: _scan_block(c, q, top), _MATCH)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"))
