"""Approximate nearest neighbours by largest inner product, with an adaptive scan of dimensions.

An inverted-list index: k-means centres are fitted on a bounded sample, and every vector is put in its nearest
list. One more dimension makes the largest inner product the least distance, and a random rotation spreads the
distance evenly over the dimensions. A query probes the lists nearest to it first. The distance of its best so far
then decides, query by query, which other lists may still hold a nearer vector: members lie about a list's
radius from its centre in directions that a query's is nearly at right angles to, so the least distance to be
expected follows from the distance of the centre, the radius and a margin of standard deviations. The margin is
set on ``trial_queries`` of the sample, whose nearest among all vectors are found by one pass. Within a probed list the rotated vectors are scanned in column blocks:
after each block the partial distance, scaled to all dimensions, is held against the least distance that can
still matter, and a candidate that exceeds it by the margin of the hypothesis test is abandoned (Gao and Long,
2023). The first such distance comes from the sample, whose best vectors are found in any case, so that every
query has its number of neighbours. What survives is scored on the original vectors in double precision, term
by term in order, so equal vectors score equally wherever they are.

Equal vectors form one class, which stands in the scan once and carries the ids that can be in a result;
lists are cut into blocks of bounded size, and so are the queries that meet in a block. Distances are taken of
vectors in units of the largest component, so components of any finite size can be compared.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors of
another dimension than most, take no part, neither as queries nor as candidates; rows without an id neither.
Ties go to the smaller id; repeated rows with one id count once; an empty table gives an empty result. A score
beyond the range of double precision is infinite.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drawn, stash


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds what the driver fits on; ``first_lists`` are probed by every query; ``target_recall``
    of the trial queries' nearest in other lists must be within reach; the rest are sizes and margins."""

    sample_rows: int = 4096
    list_rows: int = 2000
    most_lists: int = 1024
    block_rows: int = 8000
    query_rows: int = 8000
    first_lists: int = 4
    trial_queries: int = 128
    target_recall: float = 0.98
    margin: float = 2.1
    columns: int = 16
    seed: int = 7


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centres: np.ndarray  # of augmented, rotated vectors
    scale: float  # the largest component
    bound: float  # square of the largest norm in units of it, which the added dimension levels
    sample: np.ndarray  # original vectors
    sample_ids: list[list[int]]


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _augment(x: np.ndarray, bound: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(bound - (x * x).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centres, 1)[:, 0]
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        filled = counts > 0
        centres = np.where(filled[:, None], sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 4096):
        far = (centres * centres).sum(1) - 2 * (x[at : at + 4096] @ centres.T)
        if k == 1:
            out[at : at + 4096, 0] = far.argmin(1)
        else:
            out[at : at + 4096] = np.argsort(far, 1, kind="stable")[:, :k]
    return out


def may_hold(far: np.ndarray, radii: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For centres at squared distances ``far``: the squared distance of most members, and its standard deviation."""
    return far + radii[None, :] ** 2, 2 * np.sqrt(np.maximum(far, 0)) * radii[None, :] / np.sqrt(width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def fit(vectors: DataFrame, rows: int, scale: float, bound: float, settings: Settings = Settings(), k: int = 20) -> Index:
    """An index from at most ``sample_rows`` of the distinct vectors (``ids``, ``v``)."""
    found = drawn(vectors.select("ids", "v"), settings.sample_rows).collect()
    sample = np.array([r.v for r in found], np.float64).reshape(len(found), -1)
    ids = [list(r.ids) for r in found]
    rng = np.random.default_rng(settings.seed)
    width = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
    turned = _augment(sample / scale, bound) @ rotation
    lists = int(np.clip(round(rows / settings.list_rows), 1, min(settings.most_lists, max(1, len(sample) // 4))))
    if lists == 1:
        return Index(rotation, turned.mean(0, keepdims=True), scale, bound, sample, ids)
    return Index(rotation, _kmeans(turned, lists, rng), scale, bound, sample, ids)


def reach_of(placed: DataFrame, radii: np.ndarray, index: Index, settings: Settings, k: int) -> float:
    """The standard deviations that keep ``target_recall`` of what lies beyond the first lists of the trial queries.

    Each batch of all vectors gives its ``k`` nearest of each trial query, so what is shuffled is bounded by their number.
    """
    queries = index.sample[: settings.trial_queries]
    turned = np.hstack([queries / index.scale, np.zeros((len(queries), 1))]) @ index.rotation

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _squares(turned, _augment(_matrix(batch.column(0)) / index.scale, index.bound) @ index.rotation)
            n = min(k + 1, batch.num_rows)
            some = np.argpartition(far, n - 1, 1)[:, :n]
            at = pa.array(some.ravel(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries)), n), pa.int32()), batch.column(1).take(at), pa.array(np.take_along_axis(far, some, 1).ravel())], ["query", "list", "far"])

    near = placed.select("v", "list").mapInArrow(best, "query int, list int, far double")
    order = Window.partitionBy("query").orderBy("far", "list")
    # the first is the query itself
    rows = near.withColumn("r", F.row_number().over(order)).where((F.col("r") > 1) & (F.col("r") <= k + 1)).collect()
    limits: dict[int, float] = {}
    for r in rows:
        limits[r.query] = max(limits.get(r.query, 0.0), r.far)
    centres = _squares(turned, index.centres)
    expected, deviation = may_hold(centres, radii, len(index.rotation))
    ranks = np.argsort(np.argsort(centres, 1, kind="stable"), 1)
    beyond = [r for r in rows if ranks[r.query, r.list] >= settings.first_lists]
    needed = [(expected[r.query, r.list] - limits[r.query]) / max(deviation[r.query, r.list], 1e-300) for r in beyond]
    return max(0.0, float(np.quantile(needed, settings.target_recall))) if needed else 0.0


def in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first dimension to the last."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def scan(queries: np.ndarray, limits: np.ndarray, vectors: np.ndarray, least_ids: np.ndarray, index: Index, wanted: int, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its best ``wanted`` vectors of a block.

    ``limits``: squared distances beyond which nothing can be among a query's best.
    """
    width = vectors.shape[1] + 1
    turned = np.hstack([queries / index.scale, np.zeros((len(queries), 1))]) @ index.rotation
    limits = limits.copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
    norms = ((queries / index.scale) ** 2).sum(1)
    # what rounding may add to a squared distance
    slack = 1e-9 * (index.bound + norms)
    cuts = [*range(settings.columns, width, settings.columns), width]
    for at in range(0, len(vectors), 1024):
        part = _augment(vectors[at : at + 1024] / index.scale, index.bound) @ index.rotation
        for first in range(0, len(queries), 256):
            asked = turned[first : first + 256]
            # first column block for all pairs, the others for the pairs left
            c = cuts[0]
            near = (asked[:, :c] ** 2).sum(1)[:, None] + (part[:, :c] ** 2).sum(1)[None, :] - 2 * (asked[:, :c] @ part[:, :c].T)
            factor = (1 + settings.margin / np.sqrt(c)) ** 2 * c / width
            qi, xi = np.nonzero(near <= (limits[first : first + 256] * factor + slack[first : first + 256])[:, None])
            partial = near[qi, xi]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                gap = asked[qi, a:b] - part[xi, a:b]
                partial = partial + np.einsum("ij,ij->i", gap, gap)
                factor = (1 + settings.margin / np.sqrt(b)) ** 2 * b / width if b < width else 1.0
                left = partial <= limits[first + qi] * factor + slack[first + qi]
                qi, xi, partial = qi[left], xi[left], partial[left]
            if not len(qi):
                continue
            scores = in_order(queries[first + qi], vectors[at + xi])
            starts = np.searchsorted(qi, np.arange(len(asked) + 1))
            for q in np.unique(qi):
                own = slice(starts[q], starts[q + 1])
                places = np.concatenate([best[first + q][0], at + xi[own]])
                values = np.concatenate([best[first + q][1], scores[own]])
                order = np.lexsort((least_ids[places], -values))[:wanted]
                best[first + q] = (places[order], values[order])
                if len(order) == wanted:
                    limits[first + q] = min(limits[first + q], index.bound + norms[first + q] - 2 * (values[order[-1]] / index.scale / index.scale))
    return best


def search(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest that were found of each query row."""
    wanted = k + 1  # a query is among its own nearest
    rows = table.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    widths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"))
    most = widths.orderBy(F.desc("n"), "d").first()
    if most is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    rows = rows.where(F.size("v") == most.d)

    # Classes of equal vectors: the ids that can be in a result, gathered from salted parts of bounded size.
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, most.n // 100_000)))
    least = lambda x: F.slice(F.sort_array(F.array_distinct(x)), 1, wanted)
    parts = rows.groupBy("v", salt.alias("salt")).agg(least(F.collect_list("id")).alias("ids"), F.max("asked").alias("asked"))
    classes = parts.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("asked").alias("asked"))
    classes = stash(classes.select(F.element_at("ids", 1).alias("id"), "ids", "v", "asked"), "vector-classes")

    bound = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / most.top) * (x / most.top)))).first()[0]
    index = fit(classes, most.n, most.top, bound, settings, k)
    turned = lambda q: np.hstack([q / index.scale, np.zeros((len(q), 1))]) @ index.rotation
    limit = lambda x, worst: float(index.bound + ((x / index.scale) ** 2).sum() - 2 * (worst / index.scale / index.scale))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, off = np.empty(0, np.int32), np.empty(0)
            if batch.num_rows:
                x = _augment(_matrix(batch.column(2)) / index.scale, index.bound) @ index.rotation
                at = _nearest(x, index.centres, 1)[:, 0]
                off = ((x - index.centres[at]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(at, pa.int32()), pa.array(off, pa.float64())], ["id", "ids", "v", "list", "off"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest lists, the best of the sample, and the squared distance of the last of them, which bounds the best of all."""
        for batch in batches:
            lists, limits, near = [], [], []
            if batch.num_rows:
                q = _matrix(batch.column(1))
                lists = list(_nearest(turned(q), index.centres, min(settings.first_lists, len(index.centres))))
                for x in q:
                    scores = (index.sample / index.scale) @ (x / index.scale)
                    some = np.argpartition(-scores, wanted)[: wanted + 1] if len(scores) > wanted else np.arange(len(scores))
                    exact = in_order(np.broadcast_to(x, (len(some), len(x))), index.sample[some])
                    found = sorted((-s, i) for p, s in zip(some.tolist(), exact.tolist(), strict=True) for i in index.sample_ids[p])[:wanted]
                    near.append([{"vec_id": i, "score": -s} for s, i in found])
                    limits.append(limit(x, -found[-1][0]) if len(found) == wanted else float("inf"))
            kinds = [pa.list_(pa.int32()), pa.float64(), pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip((lists, limits, near), kinds, strict=True))], ["qid", "q", "lists", "most", "near"])

    placed = stash(classes.select("id", "ids", "v").mapInArrow(place, "id long, ids array<long>, v array<double>, list int, off double"), "placed")
    # a row for each list, at most ``most_lists``
    stats = {r["list"]: (r["n"], r["radius"]) for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.sqrt(F.avg("off")).alias("radius")).collect()}
    radii = np.array([stats.get(i, (0, 0.0))[1] for i in range(len(index.centres))])
    filled = np.array([i in stats for i in range(len(index.centres))])
    reach = reach_of(placed, radii, index, settings, k) if len(index.centres) > settings.first_lists else 0.0
    asked = stash(classes.where("asked").select("id", "v").mapInArrow(first, "qid long, q array<double>, lists array<int>, most double, near array<struct<vec_id:long,score:double>>"), "asked")

    def scanned(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if candidates.num_rows and queries.num_rows:
            vectors, q = _matrix(candidates["v"]), _matrix(queries["q"])
            own = candidates["ids"].to_pylist()
            least_ids = np.array([x[0] for x in own], np.int64)
            best = scan(q, queries["most"].to_numpy(), vectors, least_ids, index, wanted, settings)
            for qid, (places, scores) in zip(queries["qid"].to_pylist(), best, strict=True):
                found = sorted((-s, i) for p, s in zip(places.tolist(), scores.tolist(), strict=True) for i in own[p])[:wanted]
                out[0].extend([qid] * len(found))
                out[1].extend(i for _, i in found)
                out[2].extend(-s for s, _ in found)
        return pa.table({"qid": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    def probed(queries: DataFrame) -> DataFrame:
        """What queries (``qid``, ``q``, ``most``, ``list``) find: lists in blocks, and the queries that meet them in groups."""
        meets = {r["list"]: r["count"] for r in queries.groupBy("list").count().collect()}
        counted = lambda found, each: F.create_map(*(F.lit(x) for i in range(len(index.centres)) for x in (i, max(1, -(-found.get(i, 0) // each)))))[F.col("list")]
        blocks, groups = counted({i: n for i, (n, _) in stats.items()}, settings.block_rows), counted(meets, settings.query_rows)
        wanted_lists = placed.where(F.col("list").isin(*meets)) if len(meets) < len(stats) else placed
        left = wanted_lists.select("ids", "v", "list", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"))
        right = queries.withColumn("part", F.pmod(F.xxhash64("qid"), groups).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        by = ["list", "block", "part"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(scanned, "qid long, vec_id long, score double")

    def nearest(found: DataFrame) -> DataFrame:
        """``near``: each query's best, in order."""
        ranked = found.distinct().withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= wanted)
        return ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))

    sampled = asked.select("qid", F.explode("near").alias("n")).select("qid", "n.vec_id", "n.score")
    early = probed(asked.select("qid", "q", "most", F.explode("lists").alias("list")))
    lists = stash(nearest(sampled.unionByName(early)), "nearest")

    if len(index.centres) > settings.first_lists:

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The lists beyond the first that may hold a nearer vector than the last of a query's best."""
            for batch in batches:
                rows, found, limits = [], [], []
                if batch.num_rows:
                    q = _matrix(batch.column(1))
                    limits = np.array([m if w is None else min(m, limit(x, w)) for m, w, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), q, strict=True)])
                    far = _squares(turned(q), index.centres)
                    expected, deviation = may_hold(far, radii, len(index.rotation))
                    may = (expected - reach * deviation <= limits[:, None]) & filled[None, :]
                    for i, done in enumerate(batch.column(2).to_pylist()):
                        may[i, done] = False
                    rows, found = np.nonzero(may)
                    limits = limits[rows]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(limits, pa.float64()), pa.array(found, pa.int32())], ["qid", "q", "most", "list"])

        worst = lists.where(F.size("near") == wanted).select(F.col("qid").alias("w"), F.element_at("near", -1)["score"].alias("worst"))
        known = asked.join(worst, F.col("qid") == F.col("w"), "left").select("qid", "q", "lists", "most", "worst")
        more = stash(known.mapInArrow(others, "qid long, q array<double>, most double, list int"), "probes")
        if not more.isEmpty():
            before = lists.select("qid", F.explode("near").alias("n")).select("qid", "n.vec_id", "n.score")
            lists = stash(nearest(before.unionByName(probed(more))), "nearest")

    with_vectors = lists.join(asked.select(F.col("qid").alias("__q"), "q"), F.col("qid") == F.col("__q"))
    queries = rows.where("asked").select(F.col("id").alias("query_id"), "v").distinct()
    own = queries.join(with_vectors, queries["v"] == with_vectors["q"])
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(near).alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))
