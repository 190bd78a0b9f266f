"""Exact deduplication with counting quotient filters.

A text's 64-bit fingerprint is split into a quotient (its high bits) and a remainder (its low
bits). Every partition builds a counting quotient filter: for each quotient the sorted remainders
with their counts. Filters merge losslessly, because runs of one quotient merge by their sorted
remainders and add the counts. Quotients are dealt to tasks in blocks, so no task sees a whole
filter. Fingerprints with a merged count above one route their documents to byte verification: a
group-by on the full text, combined map-side, so a group of copies of any size stays small.

Edge cases: a null text counts as empty, so null and empty texts are copies of each other; null or
repeated ids are kept as rows (the largest id of a group stays; a repeated id that stays is kept in
each of its rows); an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20  # fingerprints of a block of quotients, the unit that is dealt to tasks
LEAST_BITS = 6  # high bits of the fingerprint that number the blocks, at least
QUOTIENT_BITS = 32


def _runs(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with added counts: order is (quotient, remainder)."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, dtype=np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def _pack(h: np.ndarray, n: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """The filter's blocks: occupied quotients, their run lengths, sorted remainders, counts."""
    if not len(h):
        return []
    out = []
    block = h >> np.uint64(64 - bits)
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    for i, j in zip(edges, [*edges[1:], len(h)], strict=True):
        quotient = (h[i:j] >> np.uint64(64 - QUOTIENT_BITS)).astype("<u4")
        occupied, lengths = np.unique(quotient, return_counts=True)
        remainder = (h[i:j] & np.uint64(2 ** (64 - QUOTIENT_BITS) - 1)).astype("<u4")
        out.append((int(block[i]), occupied.tobytes(), lengths.astype("<u4").tobytes(), remainder.tobytes(), n[i:j].astype("<u8").tobytes()))
    return out


def _unpack(occupied: bytes, lengths: bytes, remainder: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    quotient = np.repeat(np.frombuffer(occupied, "<u4"), np.frombuffer(lengths, "<u4")).astype(np.uint64)
    return (quotient << np.uint64(64 - QUOTIENT_BITS)) | np.frombuffer(remainder, "<u4"), np.frombuffer(counts, "<u8").astype(np.int64)


_FILTER = "block long, occupied binary, lengths binary, remainders binary, counts binary"


def partition_filters(fingerprints: DataFrame, size: int, column: str = "fp") -> DataFrame:
    """One counting quotient filter per partition, as rows of quotient blocks; ``size``: fingerprints in all."""
    bits = min(QUOTIENT_BITS, max(LEAST_BITS, math.ceil(math.log2(max(size, 1) / BLOCK))))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        held, size = [], 0
        for pdf in batches:
            held.append(pdf.iloc[:, 0].to_numpy(np.int64).view(np.uint64))
            size += len(held[-1])
            if size > max(len(h), 1 << 20):  # sorting in when the filter doubles keeps the cost near one sort
                h, n = _runs(np.concatenate((h, *held)), np.concatenate((n, np.ones(size, np.int64))))
                held, size = [], 0
        yield pd.DataFrame(_pack(*_runs(np.concatenate((h, *held)), np.concatenate((n, np.ones(size, np.int64)))), bits), columns=["block", "occupied", "lengths", "remainders", "counts"])

    return fingerprints.select(column).mapInPandas(build, _FILTER)


def merged_filter(filters: DataFrame) -> DataFrame:
    """Filters of all partitions merged by sorted remainders: (fp, n) with n above one."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(*row) for row in pdf[["occupied", "lengths", "remainders", "counts"]].itertuples(index=False)]
        h, n = _runs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        more = n > 1
        return pd.DataFrame({"fp": h[more].view(np.int64), "n": n[more]})

    return filters.groupBy("block").applyInPandas(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = base.select("id", F.xxhash64("text").alias("fp"), F.sha2("text", 256).alias("sha"))
    repeated = merged_filter(partition_filters(base.select(F.xxhash64("text").alias("fp")), docs.count())).select("fp")
    # byte verification: only texts whose fingerprint repeats, grouped by the bytes themselves
    verified = (
        base.withColumn("fp", F.xxhash64("text")).join(repeated, "fp", "left_semi")
        .groupBy("text").agg(F.max("id").alias("keep"), F.count("*").alias("size"))
        .select(F.sha2("text", 256).alias("sha"), "keep", "size").where("size > 1")
    )
    return hashed.join(verified, "sha", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("size").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
