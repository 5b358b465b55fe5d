"""Exact top-k by inner product with a paged M-tree and best-first search.

Vectors become whole numbers, floor(1024 x), so scores are exact. One more component, sqrt(M - |x|^2) with M the largest
squared norm, puts all vectors at one distance from the origin; then d(q, x)^2 = |q|^2 + M - 2 q.x for a query whose extra
component is zero, and the nearest by distance are the best by inner product.

The tree: routing objects come from a bounded sample; every vector goes to its nearest one, and a routing object's vectors are
dealt into pages of bounded size, so a group of equal vectors fills many pages. A page is a node with its routing object, its
covering radius, and its entries sorted by their distance to the routing object (the stored parent distance). Pages of
neighbouring routing objects form a subtree, whose node stores the same for its pages. A task searches one subtree for one
block of queries: nodes wait in order of the least distance their radius allows, a node beyond the k-th best so far ends the
search, and inside a page only entries whose parent distance lies within that distance of the query's are computed.

Rows whose id or vector is null, and vectors that hold null or non-finite components, take no part; shorter vectors are
filled with zeros. Rows that share the id of a query are the query's own. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from thermofleet.llm.tables import stored

SCALE = 1024
ROUTERS = 256  # routing objects, taken from the rows with the smallest id hashes
PAGE = 512  # entries of a page, about
SUBTREE = 32_768  # entries of a subtree, about
QUERIES = 2_048  # queries of a block, about


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of long) and norm for the rows that take part."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    v = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    norm = F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    return rows.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("norm", norm)


def _matrix(column: pa.ChunkedArray | pd.Series | list, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _extra(norms: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - norms, 0.0))


def _apart(a: np.ndarray, b: np.ndarray, extra_a: np.ndarray, extra_b: float) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1) + (extra_a - extra_b) ** 2)


class _Best:
    """The k best (score, smaller id first) of a query."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def offer(self, score: int, vec_id: int) -> None:
        item = (score, -vec_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)

    def least(self) -> float:
        return self.heap[0][0] if len(self.heap) == self.k else -np.inf


def _search(pages: list[dict], queries: np.ndarray, query_ids: np.ndarray, most: float, k: int, exact: bool) -> Iterator[tuple]:
    """Best-first search of one subtree for each query of a block."""
    centres = np.array([p["centre"] for p in pages])
    extras = np.array([p["extra"] for p in pages])
    radii = np.array([p["radius"] for p in pages])
    for q, own in zip(queries, query_ids, strict=True):
        qq = float(q @ q)
        to_centre = np.sqrt(((centres - q) ** 2).sum(axis=1) + extras ** 2)
        waiting = [(float(b), j) for j, b in enumerate(np.maximum(to_centre - radii, 0.0))]
        heapq.heapify(waiting)
        best = _Best(k)
        while waiting:
            bound, j = heapq.heappop(waiting)
            reach = np.sqrt(max(qq + most - 2 * best.least(), 0.0)) * (1 + 1e-9) + 1e-6 if np.isfinite(best.least()) else np.inf
            if bound > reach:
                break
            page = pages[j]
            a = np.searchsorted(page["apart"], to_centre[j] - reach)
            b = np.searchsorted(page["apart"], to_centre[j] + reach, "right")
            if a >= b:
                continue
            part = page["vectors"][a:b]
            scores = part @ q if exact else part.astype(np.int64).astype(object) @ q.astype(np.int64).astype(object)
            ids = page["ids"][a:b]
            scores = np.where(ids == own, -np.inf, scores) if exact else scores
            use = np.flatnonzero(scores >= best.least()) if exact else range(len(ids))
            if exact and len(use) > k:
                use = use[np.lexsort((ids[use], -scores[use]))[:k]]
            for i in use:
                if ids[i] != own:
                    best.offer(int(scores[i]), int(ids[i]))
        for score, vec_id in best.heap:
            yield int(own), -vec_id, score


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of the largest inner product with each query's vector."""
    spark = rows.sparkSession
    whole = stored(whole_vectors(rows), "whole-vectors")
    facts = whole.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("v"))).first()
    total, most, width = facts[0], float(facts[1] or 0.0), int(facts[2] or 0)
    exact = most < 2.0 ** 52  # then doubles hold every product and sum exactly
    routers = [r["v"] for r in whole.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(ROUTERS).collect()]
    routers = np.unique(_matrix(routers, width), axis=0) if routers else np.zeros((0, width))
    # routing objects that are near each other get neighbouring numbers
    first = routers[0] if len(routers) else None
    if first is not None:
        routers = routers[np.argsort(((routers - first) ** 2).sum(axis=1), kind="stable")]
    shared = spark.sparkContext.broadcast((routers, _extra((routers ** 2).sum(axis=1), most)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, extras = shared.value
        norms = (centres ** 2).sum(axis=1) + extras ** 2
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                some = batch.slice(at, 4_096)
                v = _matrix(some.column(1).to_pylist(), width)
                extra = _extra((v ** 2).sum(axis=1), most)
                near = np.argmin(norms - 2 * (v @ centres.T + np.outer(extra, extras)), axis=1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(near.astype(np.int32))], names=["vec_id", "v", "router"])

    routed = stored(whole.select("vec_id", "v").mapInArrow(route, "vec_id long, v array<long>, router int"), "routed")
    sizes = routed.groupBy("router").agg(F.count(F.lit(1)).alias("n")).withColumn("pages", F.ceil(F.col("n") / PAGE).cast("int"))
    paged = routed.join(F.broadcast(sizes), "router")  # at most ROUTERS rows
    paged = paged.withColumn("page", F.pmod(F.xxhash64("vec_id", "v"), F.col("pages")).cast("int"))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        centres, extras = shared.value
        router, page = int(key[0]), int(key[1])
        v = _matrix(frame["v"], width)
        apart = _apart(v, centres[router], _extra((v ** 2).sum(axis=1), most), extras[router])
        order = np.argsort(apart, kind="stable")
        return pd.DataFrame([(router, page, len(frame), float(apart.max()), frame["vec_id"].to_numpy(np.int64)[order].tobytes(), v[order].astype(np.int64).tobytes(), apart[order].tobytes())],
                            columns=["router", "page", "n", "radius", "ids", "vectors", "apart"])

    leaves = "router int, page int, n long, radius double, ids binary, vectors binary, apart binary"
    tree = stored(paged.groupBy("router", "page").applyInPandas(build, leaves), "pages")

    # a subtree holds neighbouring routers until it is full; a router with more entries than that has several subtrees
    homes, number, held = [], 0, 0
    for r in sorted(sizes.collect(), key=lambda r: r["router"]):  # at most ROUTERS rows
        shares = -(-r["n"] // SUBTREE)
        if held and (shares > 1 or held + r["n"] > SUBTREE):
            number, held = number + 1, 0
        homes.append((r["router"], number, shares))
        number, held = (number + shares, 0) if shares > 1 else (number, held + r["n"])
    subtrees = number + (held > 0)
    home = spark.createDataFrame(homes, "router int, home int, shares int")
    nodes = tree.join(F.broadcast(home), "router").withColumn("subtree", F.col("home") + F.pmod(F.col("page"), F.col("shares")))

    # every block of queries visits every subtree: a grid of groups that are bounded on both sides
    blocks = max(1, -(-total // (100 * QUERIES)))
    left = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = whole_vectors(queries).dropDuplicates(["vec_id", "v"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def bundle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = frame["vec_id"].to_numpy(np.int64).tobytes(), _matrix(frame["v"], width).astype(np.int64).tobytes()
        return pd.DataFrame([(int(key[0]), ids, vectors)], columns=["block", "ids", "vectors"])

    right = asked.groupBy("block").applyInPandas(bundle, "block int, ids binary, vectors binary")
    right = stored(right, "query-blocks").withColumn("subtree", F.explode(F.sequence(F.lit(0), F.lit(max(subtrees - 1, 0)))))

    def search(pages: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(pages) and len(questions) and width:
            centres, extras = shared.value
            held = [{
                "centre": centres[r], "extra": extras[r], "radius": radius, "ids": np.frombuffer(i, np.int64),
                "vectors": np.frombuffer(x, np.int64).reshape(-1, width).astype(float), "apart": np.frombuffer(d, float),
            } for r, radius, i, x, d in zip(pages["router"], pages["radius"], pages["ids"], pages["vectors"], pages["apart"], strict=True)]
            for i, x in zip(questions["ids"], questions["vectors"], strict=True):
                out += _search(held, np.frombuffer(x, np.int64).reshape(-1, width).astype(float), np.frombuffer(i, np.int64), most, k, exact)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("subtree", "block").cogroup(right.groupBy("subtree", "block")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
