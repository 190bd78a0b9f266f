"""Best-fit packing of tokenised documents under several capacities at once.

Each sequence (bin) has a residual vector: tokens, documents and attention cost (the sum of squared
piece lengths). Pieces go in order of falling length; a piece may enter a sequence only if every
residual suffices. Among these, rule ``norm`` takes the one that leaves the smallest weighted norm
of residuals, rule ``dot`` the one whose residuals have the largest weighted dot product with the
piece's demand. Only a document longer than a sequence is cut; its first piece takes the remainder.

Pieces are dealt at random to groups of about ``GROUP`` documents and each group is packed in a
task of its own, so the work grows linearly; a group leaves a few sequences partly filled at most.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each for itself; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids as ids_of
from .common import new_path, nullable
from .tokens import encoder, in_slices

GROUP = 32_768


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds at most; weights of the three dimensions in the choice of a sequence."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"

    @property
    def longest(self) -> int:
        return max(1, min(self.tokens, math.isqrt(self.cost)))


def pieces(docs: DataFrame, tokenizer: str, capacity: Capacity, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids) of every document; ids are little-endian 32-bit."""
    longest = capacity.longest

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = np.asarray([end_id], "<u4").tobytes()
        for pdf in batches:
            names = ids_of(pdf["id"])
            for first, texts in in_slices(pdf["text"].tolist()):
                rows = []
                for k, ids in enumerate(encoder(tokenizer).encode(texts), first):
                    ids += tail
                    n = len(ids) // 4
                    cut = [0, *range(n % longest or longest, n + 1, longest)]
                    view = memoryview(ids)
                    rows += [(names[k], p, a, b - a, bytes(view[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids"]).astype({"id": object})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        build, f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary"
    )


def best_fit(lengths: np.ndarray, c: Capacity) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each piece, offset in it, number of bins) for pieces no longer than a sequence."""
    caps = np.array([c.tokens, c.documents, c.cost], np.float64)
    scale = np.sqrt(np.array(c.weights)) / caps
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int(np.searchsorted(-lengths[order], -c.tokens, side="right"))
    where[order[:full]] = np.arange(full)
    least = int(lengths.min()) if len(lengths) else 0
    room = np.empty((3, 64), np.float64)  # residuals of the open bins
    name = np.empty(64, np.int64)
    n, made = 0, full
    for step, item in enumerate(order[full:]):
        size = int(lengths[item])
        need = np.array([size, 1, size * size], np.float64)
        pick = -1
        if n:
            left = room[:, :n] - need[:, None]
            fits = np.flatnonzero((left >= 0).all(axis=0))
            if len(fits):
                if c.rule == "dot":
                    pick = fits[np.argmax((scale * scale * need) @ room[:, fits])]
                else:
                    rest = left[:, fits] * scale[:, None]
                    pick = fits[np.argmin(np.einsum("ij,ij->j", rest, rest))]
        if pick < 0:
            if n == room.shape[1]:
                room, name = np.concatenate((room, np.empty_like(room)), axis=1), np.concatenate((name, np.empty_like(name)))
            pick, n = n, n + 1
            room[:, pick], name[pick] = caps, made
            made += 1
        where[item], offset[item] = name[pick], c.tokens - room[0, pick]
        room[:, pick] -= need
        if room[0, pick] < least or room[1, pick] < 1 or room[2, pick] < least * least:  # nothing fits any more
            n -= 1
            room[:, pick], name[pick] = room[:, n], name[n]
    return where, offset, made


def packed(cut: DataFrame, capacity: Capacity, groups: int) -> DataFrame:
    """The pieces with sequence_id and offset."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        where, offset, _ = best_fit(pdf["length"].to_numpy(), capacity)
        return nullable(pdf.drop(columns="part"), kinds).assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return cut.withColumn("part", F.pmod(F.xxhash64(*cut.columns), F.lit(groups))).groupBy("part").applyInPandas(pack, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: Capacity | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All documents tokenised, cut and packed: id, piece, start, length, ids, sequence_id, offset, ids_crc32."""
    capacity = capacity or Capacity()
    groups = max(1, math.ceil(docs.count() / GROUP))
    cut = pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    path = new_path(docs.sparkSession, "pieces")
    cut.write.option("compression", "zstd").parquet(path)
    cut = docs.sparkSession.read.schema(cut.schema).parquet(path)
    placed = packed(cut.select("row", "length"), capacity, groups).drop("length")  # the ids stay out of the groups
    found = cut.join(placed, "row").drop("row").withColumnRenamed("id", id_col)
    return found.withColumn("ids_crc32", F.crc32("ids"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences, their pieces one after another by offset."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(in_order, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
