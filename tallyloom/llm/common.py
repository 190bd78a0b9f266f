"""Helpers that several operators share: written intermediate tables, word shingles, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- written intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on this machine alone that names none gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs at most the step in progress.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tallyloom_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` that nothing reads any more."""
    path = getattr(df, "_tallyloom_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


BROADCAST_IDS = 1 << 20  # longest list of ids that goes to every executor; longer ones are joined by shuffle


def of_ids(docs: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """``docs`` joined with a written table of ids (and what is asked of each), whose size is counted first.

    A short table goes to the executors, so that the texts stay where they are.
    """
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(wanted) if few else wanted, key)


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps between tasks: one model at a time, so that caches of steps that are over go."""
    if key not in _resident:
        _resident.clear()
        gc.collect()
        _resident[key] = make()
    return _resident[key]


def nullable(pdf: pd.DataFrame, kinds: dict[str, str]) -> pd.DataFrame:
    """Whole-number columns that pandas reads as floats, because they hold nulls, as nullable integers."""
    own = [c for c in pdf.columns if kinds.get(c) in ("bigint", "int", "smallint", "tinyint") and pdf[c].dtype.kind == "f"]
    return pdf.astype(dict.fromkeys(own, "Int64")) if own else pdf


def ids(column: pd.Series) -> list:
    """Ids as Python values, null as None."""
    if column.dtype.kind == "f":
        return [None if x != x else int(x) for x in column]
    return column.tolist()


# ---------------------------------------------------------------- words and shingles

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def normal_words(text: str | None) -> bytes:
    """Lower-case A-Z and join the words ``[^\\x20\\x09-\\x0D]+`` by one space."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_LOWER).split())


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[starts[i]:ends[i]]``.

    One polynomial over a random value per byte, taken from prefix sums, so the cost is that of
    the bytes and not of the spans. Spans are handled in blocks to bound memory on huge texts.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    a = np.frombuffer(data, dtype=np.uint8)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _BLOCK)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[a[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_spans(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(norm)]))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles.

    Fewer words than a shingle: the whole sequence is the only shingle. No words: empty.
    """
    norm = normal_words(text)
    if not norm:
        return np.empty(0, dtype=np.uint64)
    starts, ends = word_spans(norm)
    k = min(words, len(starts))
    return np.unique(span_hashes(norm, starts[: len(starts) - k + 1], ends[k - 1 :]))


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge table; component = smallest node.

    Rounds of large-star and small-star over written tables: each round points nodes at the
    smallest neighbour they know, so long chains shrink geometrically. Grouping uses ``min`` with
    map-side combining; no edge list, component or group is collected anywhere.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    now = written(pairs, "edges")
    first, before = now, None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: each larger neighbour of u goes to the smallest one around u
        large = written(
            both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct(),
            "large",
        )
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        after = written(small, "small")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(large)
        if now is not first:
            dropped(now)
        now = after
        if state == before:
            break
        before = state
    nodes = first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).distinct()
    return nodes.join(now.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
