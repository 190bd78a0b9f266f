"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Inner products become distances by one more dimension (``sqrt(M^2 - |x|^2)``, 0 for a query), which
is then turned by a fixed random rotation. Vectors lie in lists around centroids fitted on a bounded
sample; each query probes the lists of the nearest centroids. Within a list the rotated vectors are
scanned in blocks of columns: after each block the partial distance, scaled to all dimensions, is
held against the query's current 20th distance, and a hypothesis test with error parameter
``EPSILON`` abandons those that cannot come in. Survivors get their exact inner product in double
precision on the original vectors.

Equal vectors are one class with its ``top + 1`` smallest ids, found by a salted top-k; equal queries
are searched once. Lists go to tasks in blocks; blocks longer than ``BLOCK_ROWS`` are cut by a hash of the id, so a
list that holds a third of all rows is many tasks, and so are ``PROBE_ROWS`` queries of a part.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as queries or candidates; a query whose probed lists hold fewer than it
asks for is held against all lists, so only fewer candidates give fewer neighbours; ties go to the smaller id; repeated ids count as one vector; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIT_ROWS = 16_384  # bound on the sample that centroids are fitted on
BLOCK_LISTS = 16  # neighbouring lists that go to one task
BLOCK_ROWS = 4_096  # rows of a part of such a block
PROBE_ROWS = 4_096  # queries of such a part that one task takes
MOST_LISTS = 4_096
PROBED = 0.5  # share of the lists that a query probes
LEAST_PROBES = 16  # and so many more
FIRST = 2  # of these, the nearest are searched first and give the query's limit
COLUMNS = 16  # dimensions scanned between two tests
EPSILON = 2.1  # larger: fewer candidates are abandoned by mistake


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): vectors that take part, as arrays of double."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & fine)
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("x") == (size[0]["d"] if size else 0))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(x, ids): distinct vectors, each with its ``keep`` smallest ids; a salted top-k, no long groups."""

    def least(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(f"rank <= {keep}")

    keyed = rows.dropDuplicates(["id", "x"]).withColumn("key", F.xxhash64("x")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = least(least(keyed, "key", "x", "salt"), "key", "x")
    return few.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _fit(classes: DataFrame, n: int, lists: int) -> np.ndarray:
    """Centroids by k-means (spherical in effect, vectors scaled to length 1) on a bounded sample."""
    share = min(1.0, FIT_ROWS / max(n, 1))
    drawn = classes.where(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64(F.col("ids")[0])).select("x").limit(2 * FIT_ROWS).toPandas()
    x = np.stack(drawn["x"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(7)
    c = x[rng.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(8):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def _scan(rows: np.ndarray, queries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) positions that survive; rows and queries rotated, limits: squared distances.

    All queries of the block go together: the first block of columns is one product, the pairs that
    remain after each test are gathered for the next block.
    """
    d = rows.shape[1]
    q, r, part = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for at in range(0, d, COLUMNS):
        a, b = queries[:, at : at + COLUMNS], rows[:, at : at + COLUMNS]
        seen = min(d, at + COLUMNS)
        bound = limits if seen == d else limits * (seen / d) * (1 + EPSILON / math.sqrt(seen)) ** 2
        if at == 0:
            dist = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
            q, r = np.nonzero(dist <= bound[:, None])
            part = dist[q, r]
        else:
            part = part + ((a[q] - b[r]) ** 2).sum(axis=1)
            keep = part <= bound[q] + 1e-9
            q, r, part = q[keep], r[keep], part[keep]
    return q, r


def nearest(vectors: DataFrame, is_query: Column, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", probed_share: float = PROBED) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` nearest of the other rows found."""
    rows = usable(vectors, id_col, vec_col)
    # all vectors scaled by one power of two, which rounds nothing, so that squares neither overflow nor vanish
    largest = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 1.0
    power = min(max(math.frexp(largest)[1], -1000), 1000)
    rows = rows.withColumn("x", F.transform("x", lambda v: v * 2.0**-power)).where(F.exists("x", lambda v: v != 0))
    classes = written(_classes(rows, top + 1), "classes")
    asked = rows.where(is_query).dropDuplicates(["id"]).join(classes.select("x", F.col("ids")[0].alias("cls")), "x").select(F.col("id").alias("query_id"), "cls")
    asked = written(asked, "asked")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("m")).first()
    n, most = stats["n"], stats["m"] or 1.0
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(min(MOST_LISTS, max(1, math.ceil(n / 128))))
    centroids = _fit(classes, n, lists)
    lists = len(centroids)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    probed = min(lists, LEAST_PROBES + math.ceil(probed_share * lists))

    def own_list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = np.stack(pdf["x"].to_numpy()) @ shared.value.T if len(pdf) else np.empty((0, 1))
            own = near.argmax(axis=1).astype(np.int32)
            yield pdf.assign(list=own, block=own // BLOCK_LISTS)

    def own_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each block of lists that holds probed ones; those of the first turn apart."""
        for pdf in batches:
            out = []
            for who, x in zip(pdf["cls"], pdf["x"], strict=True):
                order = np.argsort(-(shared.value @ x), kind="stable")[:probed].astype(np.int32)
                for turn, own in ((1, np.sort(order[:FIRST])), (2, np.sort(order[FIRST:]))):
                    block = own // BLOCK_LISTS
                    for part in np.split(own, np.flatnonzero(np.diff(block)) + 1) if len(own) else ():
                        out.append((who, x, turn, int(part[0]) // BLOCK_LISTS, part))
            yield pd.DataFrame(out, columns=["cls", "x", "turn", "block", "lists"])

    placed = written(classes.select("x", F.col("ids")[0].alias("cls")).mapInPandas(own_list, "x array<double>, cls long, list int, block int"), "placed")
    wanted = classes.select("x", F.col("ids")[0].alias("cls")).join(asked.select("cls").distinct(), "cls", "left_semi").select("x", "cls")
    probing = written(wanted.mapInPandas(own_probes, "cls long, x array<double>, turn int, block int, lists array<int>"), "probing")
    parts = written(placed.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")), "parts")  # a row per block of lists

    def search(key: tuple, have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(have) and len(ask):
            x, v = np.stack(have["x"].to_numpy()), np.stack(ask["x"].to_numpy())
            names, turn, lists = have["cls"].to_numpy(), _rotation(x.shape[1] + 1), have["list"].to_numpy()
            more = np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))
            rotated = np.concatenate((x, more[:, None]), axis=1) @ turn
            turned = np.concatenate((v, np.zeros((len(v), 1))), axis=1) @ turn
            limits = (v * v).sum(axis=1) + most - 2 * ask["least"].to_numpy(np.float64)
            base = int(key[0]) * BLOCK_LISTS
            asks = np.zeros((len(v), BLOCK_LISTS), bool)
            asks[np.repeat(np.arange(len(v)), [len(r) for r in ask["lists"]]), np.concatenate(ask["lists"].to_numpy()) - base] = True
            q_all, r_all = [], []
            for k in range(BLOCK_LISTS):
                rows, queries = np.flatnonzero(lists == base + k), np.flatnonzero(asks[:, k])
                for at in range(0, len(queries), 256):
                    some = queries[at : at + 256]
                    q, r = _scan(rotated[rows], turned[some], limits[some])
                    q_all.append(some[q])
                    r_all.append(rows[r])
            if q_all:
                q, r = np.concatenate(q_all), np.concatenate(r_all)
                score = np.einsum("ij,ij->i", x[r], v[q])
                order = np.lexsort((names[r], -score, q))
                q, r, score = q[order], r[order], score[order]
                begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
                keep = np.arange(len(q)) - np.repeat(begin, np.diff([*begin, len(q)])) <= top
                out.append(pd.DataFrame({"asked": ask["cls"].to_numpy()[q[keep]], "cls": names[r[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"asked": [], "cls": [], "score": []}).astype({"asked": "int64", "cls": "int64", "score": "float64"})

    def searched(probes: DataFrame) -> DataFrame:
        sides = probes.groupBy("block").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("sides"))
        grid = F.broadcast(parts.join(sides, "block"))  # a row per block of lists, at most MOST_LISTS
        left = placed.join(grid, "block").select(
            "block", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), "list", "cls", "x"
        )
        right = probes.join(grid, "block").select(
            "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("cls"), F.col("sides")).cast("int").alias("side"), "cls", "x", "lists", "least"
        )
        return left.groupBy("block", "part", "side").cogroup(right.groupBy("block", "part", "side")).applyInPandas(search, "asked long, cls long, score double")

    nearby = written(searched(probing.where("turn = 1").withColumn("least", F.lit(-float("inf")))), "nearby")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "cls"))
    least = nearby.withColumn("rank", rank).where(f"rank = {top + 1}").select(F.col("asked").alias("cls"), F.col("score").alias("least"))
    rest = probing.where("turn = 2").join(least, "cls", "left").fillna(-float("inf"), ["least"])
    found = nearby.unionByName(searched(rest))
    few = found.withColumn("rank", rank).where(f"rank <= {top + 1}").drop("rank")
    few = few.join(classes.select(F.col("ids")[0].alias("cls"), "ids"), "cls").select("asked", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    few = written(few.withColumn("rank", best).where(f"rank <= {top + 1}").drop("rank"), "few")
    if probed < lists:  # a query whose lists hold too few is held against all of them
        least = min(top + 1, rows.limit(top + 1).count())
        poor = asked.select("cls").distinct().join(few.groupBy(F.col("asked").alias("cls")).agg(F.count("*").alias("n")), "cls", "left").where(f"coalesce(n, 0) < {least}")
        poor = written(wanted.join(poor.select("cls"), "cls"), "poor")
        if not poor.isEmpty():
            own = F.explode(F.sequence(F.lit(0), F.lit((lists - 1) // BLOCK_LISTS)))
            every = poor.withColumn("block", own).withColumn("lists", F.sequence(F.col("block") * BLOCK_LISTS, F.col("block") * BLOCK_LISTS + BLOCK_LISTS - 1)).withColumn("least", F.lit(-float("inf")))
            more = searched(every).join(classes.select(F.col("ids")[0].alias("cls"), "ids"), "cls").select("asked", "score", F.explode("ids").alias("vec_id"))
            few = few.join(poor.select(F.col("cls").alias("asked")), "asked", "left_anti").unionByName(more.withColumn("rank", best).where(f"rank <= {top + 1}").drop("rank"))
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.withColumnRenamed("cls", "asked").join(few, "asked").where("query_id <> vec_id").withColumn("rank", F.row_number().over(each)).where(f"rank <= {top}")
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (F.col("score") * 2.0**power * 2.0**power).alias("score"))
    )
