"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its 5-word shingles; its sketch is the ``LISTED``
smallest of them. Steps:

1. Documents with equal sets (128-bit set digest and size) form one class; only one row of it, the
   one with the smallest id, goes on. A group of copies of any size costs one row.
2. Inverted lists of the retained values. Documents with too few values in lists of two or more have
   no partner and go. Of the others the full sets are made, once.
3. Every member of a list is held against the list's leaders only; most near copies join a component
   there, so their group never has its pairs enumerated.
4. Lists that still hold several components give the remaining pairs. Short lists are joined, and
   a pair must share enough of the retained values (the union-sketch estimate). In a long list the
   members outside its main component are held against all, in blocks inside the tasks, and
   only pairs that may link leave: sets of up to ``LONG_SKETCH`` values are decided exactly, others by
   a larger union-sketch estimate.
5. Whatever passed is verified on the full sets: ``100 * |A & B| >= 75 * |A | B|``.
6. Connected components of the links, named by their smallest id.

Each of the smallest values of a union lies in both sets with chance 0.75 or more, so a pair at just
that similarity shares fewer than a quarter of ``LISTED`` values with chance 4e-6, fewer than
``LEAST_LONG`` with 4e-5, and none of the ``HEAVY`` smallest with 1e-6.

Edge cases: null, empty and white-space texts have an empty set and link with nothing; texts with
fewer than five words have one shingle; rows that repeat an id are documents of their own, with
whatever text they have; null ids keep a row with their own set size, component and kept null; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, mix64, of_ids, shingle_set, written

LISTED = 16  # values kept per document, all with inverted lists
HEAVY = 10  # of these, the smallest put a document into long lists
LONG_SKETCH = 2048  # values kept of documents that are compared in long lists
SHORT = 64  # longest list whose pairs are joined
LEAST_LONG = 5  # listed values in long lists that a document needs to be compared there
BLOCK = 512  # members of a long list that are held against as many others at a time
BUCKET_ROWS = 4096  # members of lists that go to Python at a time
FEW = 9  # pairs that are compared one by one
COLUMNS = 2048  # retained values that are compared at a time
LEAST_ESTIMATE = 0.5  # union-sketch estimate of pairs that are verified


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, text_hash, n, f1, f2, low): set size, set digest and the bottom-k sketch."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(text, words) for text in pdf["text"]]
            digests = [(len(s), *_digest(s), s[:LISTED].view(np.int64)) for s in sets]
            yield pd.concat([pdf[["id"]].astype("Int64"), pdf[["text_hash"]], pd.DataFrame(digests, pdf.index, ["n", "f1", "f2", "low"])], axis=1)

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return read.mapInPandas(build, "id long, text_hash long, n long, f1 long, f2 long, low array<long>")


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix64(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, n, items): the whole sets, packed, of ``wanted`` (node, id, n, f1, f2)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, nodes in zip(pdf["text"], pdf["nodes"], strict=True):
                s = shingle_set(text, words)
                own = (len(s), *_digest(s))
                out += [(x["node"], len(s), s.tobytes()) for x in nodes if (x["n"], x["f1"], x["f2"]) == own]
            yield pd.DataFrame(out, columns=["node", "n", "items"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = written(wanted.groupBy("id").agg(F.collect_list(F.struct("node", "n", "f1", "f2")).alias("nodes")), "asked")  # rows of one id
    return of_ids(texts, asked).mapInPandas(build, "node long, n long, items binary").dropDuplicates(["node"])


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets (node, items) reach the similarity."""

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pdf.loc[np.asarray(keep, dtype=bool), ["a", "b"]]

    x, y = (sets.select(F.col("node").alias(k), F.col("items").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").mapInPandas(linked, "a long, b long")


def long_lists(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure) of long lists (v, node, comp), whose members have ``sets`` (node, n, items).

    In each list the members outside its largest component are held against all members, block by
    block. Of sure links only those leave that join components; others are still to be verified.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["v", "i", "j", "side"], kind="stable", ignore_index=True)
        at = pdf[["v", "i", "j"]].to_numpy()
        begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
        side, cols = pdf["side"].to_numpy(), [pdf[c].to_numpy() for c in ("sketch", "n", "node", "comp")]
        out: list[tuple[int, int, bool]] = []
        for a, b in zip(begin, [*begin[1:], len(pdf)], strict=True):
            z = a + int(np.searchsorted(side[a:b], 1))
            if a < z < b:
                held_against([c[a:z] for c in cols], [c[z:b] for c in cols], out)
        return pd.DataFrame(out, columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": bool})

    def held_against(left: list[np.ndarray], right: list[np.ndarray], out: list[tuple[int, int, bool]]) -> None:
        """Sides are (sketch, n, node, comp)."""
        sets = [[np.frombuffer(b, np.uint64) for b in side[0]] for side in (left, right)]
        (na, x, p), (nb, y, q) = left[1:], right[1:]
        fits = (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)) & (p[:, None] != q)
        if len(x) * len(y) <= FEW:
            for i, j in np.argwhere(fits & (x[:, None] != y)):
                decided(sets[0][i], sets[1][j], na[i], nb[j], x[i], y[j], out)
            return
        flat = [np.concatenate(side) for side in sets]
        values = np.intersect1d(*map(np.unique, flat), assume_unique=True)
        rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in sets]
        cols = [np.minimum(np.searchsorted(values, f), max(0, len(values) - 1)) for f in flat]
        held = [values[c] == f if len(values) else np.zeros(len(f), bool) for c, f in zip(cols, flat, strict=True)]
        shared, width = np.zeros(fits.shape, np.float32), min(COLUMNS, len(values))
        for at in range(0, len(values), COLUMNS):  # shared values, by products of small 0/1 grids
            grids = []
            for r, c, h, side in zip(rows, cols, held, sets, strict=True):
                own = h & (c >= at) & (c < at + width)
                grid = np.zeros((len(side), width), np.float32)
                grid[r[own], c[own] - at] = 1
                grids.append(grid)
            shared += grids[0] @ grids[1].T
        shared = np.rint(shared).astype(np.int64)
        whole = (na[:, None] <= LONG_SKETCH) & (nb <= LONG_SKETCH)
        sure = fits & whole & (100 * shared >= percent * (na[:, None] + nb - shared))
        # the smallest component spreads along sure links; the link by which it comes is enough
        lp, lq, moved = p.copy(), q.copy(), True
        while moved:
            moved = False
            for links, mine, other, here, there in ((sure, lp, lq, x, y), (sure.T, lq, lp, y, x)):
                offered = np.where(links, other[None, :], np.iinfo(np.int64).max)
                at = offered.argmin(axis=1)
                least = offered[np.arange(len(mine)), at]
                for i in np.flatnonzero(least < mine):
                    out.append((min(here[i], there[at[i]]), max(here[i], there[at[i]]), True))
                    moved = True
                np.minimum(mine, least, out=mine)
        may = fits & ~whole & (shared >= LEAST_ESTIMATE * np.minimum(LONG_SKETCH, np.minimum(na[:, None], nb))) & (lp[:, None] != lq)
        for i, j in np.argwhere(may):
            decided(sets[0][i], sets[1][j], na[i], nb[j], x[i], y[j], out)

    def decided(a: np.ndarray, b: np.ndarray, na: int, nb: int, x: int, y: int, out: list[tuple[int, int, bool]]) -> None:
        both = np.intersect1d(a, b, True)
        if max(na, nb) <= LONG_SKETCH:
            if 100 * len(both) >= percent * (na + nb - len(both)):
                out.append((min(x, y), max(x, y), True))
        else:
            k = min(LONG_SKETCH, len(a), len(b))
            if len(np.intersect1d(both, np.union1d(a, b)[:k], True)) >= LEAST_ESTIMATE * k:
                out.append((min(x, y), max(x, y), False))

    parts = members.groupBy("v", "comp").agg(F.count("*").alias("k"))
    main = written(parts.groupBy("v").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("size")).where("main.k < size").select("v", F.col("main.comp").alias("main"), "size", (F.col("size") - F.col("main.k")).alias("rest")), "mixed")
    blocks = lambda name: F.ceil(F.col(name) / BLOCK).cast("int")
    sketch = sets.select("node", "n", F.substring("items", 1, 8 * LONG_SKETCH).alias("sketch"))
    placed = members.join(main, "v").join(sketch, "node").withColumn("h", F.xxhash64("node", "v"))
    every = placed.select("v", F.explode(F.sequence(F.lit(0), blocks("rest") - 1)).alias("i"), F.pmod("h", blocks("size")).alias("j"), F.lit(1).alias("side"), "node", "n", "comp", "sketch")
    rest = placed.where("comp <> main").select("v", F.pmod("h", blocks("rest")).alias("i"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("j"), F.lit(0).alias("side"), "node", "n", "comp", "sketch")
    rows = main.agg(F.sum(blocks("rest") * F.col("size") + blocks("size") * F.col("rest"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("v", "i", "j"), F.lit(max(1, rows // BUCKET_ROWS)))  # many short lists to a call
    return every.unionByName(rest).groupBy(bucket.alias("bucket")).applyInPandas(compare, "a long, b long, sure boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, text_hash (xxhash64 of the text)."""
    drawn = written(sketches(docs, id_col, text_col, words).withColumn("node", F.monotonically_increasing_id()), "sketches")
    classes = written(drawn.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "node")).alias("first")).select("n", "f1", "f2", "first.id", "first.node"), "classes")
    postings = drawn.join(classes.select("node"), "node", "left_semi").select(F.posexplode("low").alias("k", "v"), "node", "n")
    often = written(postings.groupBy("v").count().where("count > 1").select("v"), "often")
    # a quarter of the retained values in common is the least that two linked documents have
    some = postings.join(often, "v").groupBy("node").agg(F.max("n").alias("n"), F.collect_list(F.struct("k", "v")).alias("vs")).where(f"4 * size(vs) >= least(n, {LISTED})")
    listed = written(some.select("node", "n", F.inline("vs")), "listed")
    sets = written(full_sets(docs, classes.join(listed.select("node").distinct(), "node", "left_semi"), id_col, text_col, words), "sets")
    # members against the leaders of their lists
    lists = written(listed.groupBy("v").agg(F.count("*").alias("size"), F.min(F.struct("n", "node"))["node"].alias("smallest"), F.max("node").alias("last")).where("size > 1"), "lists")
    star = (
        listed.join(lists, "v").select("node", "n", F.explode(F.array_distinct(F.array("smallest", "last"))).alias("lead"))
        .where("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
        .where(f"2 * shared >= least(n, {LISTED})").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    )
    first = written(verified_links(star, sets, percent), "links")
    early = written(components(first), "early")
    # what is left: lists that hold several components
    marked = listed.join(early, "node", "left").join(lists.select("v", "size"), "v").select("v", "k", "node", "n", "size", F.coalesce("component", "node").alias("comp"))
    marked = written(marked, "marked")
    dropped(listed)
    heavy = written(marked.where(f"size > {SHORT}").groupBy("node").agg(F.count("*").alias("h")), "heavy")
    short = marked.where(f"size <= {SHORT}").join(heavy, "node", "left").fillna(0, ["h"])
    x, y = (short.select("v", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "comp", "h")]) for k in (1, 2))
    pairs = (
        x.join(y, "v").where(f"node1 < node2 and comp1 <> comp2 and 100 * least(n1, n2) >= {percent} * greatest(n1, n2)")
        .groupBy("node1", "node2").agg(F.count("*").alias("shared"), F.max(F.greatest("n1", "n2")).alias("n"), F.max(F.least("h1", "h2")).alias("h"))
        .where(f"4 * (shared + h) >= least(n, {LISTED})").select(F.col("node1").alias("a"), F.col("node2").alias("b"), F.lit(False).alias("sure"))
    )
    # a pair without a common value in short lists has all of its common values in long ones
    enough = heavy.join(classes.select("node", "n"), "node").where(f"CASE WHEN n <= {LISTED} THEN 4 * h >= n ELSE h >= {LEAST_LONG} END").select("node")
    members = written(marked.where(f"size > {SHORT} and k < {HEAVY}").join(enough, "node", "left_semi").select("v", "node", "comp"), "members")
    more = written(pairs.unionByName(long_lists(members, sets, percent)).distinct(), "more")
    dropped(marked)
    checked = written(verified_links(more.where("not sure").select("a", "b").distinct(), sets, percent), "checked")
    dropped(sets)
    final = components(first.unionByName(more.where("sure").select("a", "b")).unionByName(checked))
    named = written(final.join(classes.select("node", "id", "n", "f1", "f2"), "node"), "components")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = named.join(least, "component").select("n", "f1", "f2", "component_id")
    own = written(classes.join(linked, ["n", "f1", "f2"], "left").select("n", "f1", "f2", F.coalesce("component_id", "id").alias("component_id")), "classes")
    number = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return drawn.select("id", "text_hash", "n", "f1", "f2").join(own, ["n", "f1", "f2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), number.alias("component_id"), (F.col("id") == number).alias("kept"), "text_hash"
    )
