"""Tables as JSON, Parquet or CSV; the correction log; reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..plans.cluster import staged

#: fixed values: field names of the JSON exchange format -> (column, type); amounts are decimals there
JSON_FIELDS = {
    "payments": {"orderId": "order_id string", "paymentId": "payment_id string", "amount": "amount cents", "currency": "currency string", "status": "status string", "createdAt": "created_at date"},
    "settlements": {
        "settlementId": "settlement_id string", "paymentId": "payment_id string", "grossAmount": "gross cents", "fee": "fee cents", "tax": "tax cents", "netAmount": "net cents",
        "settledAt": "settled_at date", "utr": "utr string", "currency": "currency string",
    },
    "bank_credits": {"id": "bank_credit_id string", "utr": "utr string", "creditedAmount": "amount cents", "creditedAt": "credited_at date", "currency": "currency string"},
    "ground_truth": {
        "bankCreditId": "bank_credit_id string", "settlementId": "settlement_id string", "settlementIds": "settlement_ids array<string>", "decoySettlementId": "decoy_settlement_id string",
        "label": "label string", "exceptionType": "exception_type string", "class": "class string", "ambiguityLevel": "level string",
    },
    "corrections": {
        "recordId": "record_id string", "source": "source string", "decision": "decision string", "correctedMatchId": "corrected_match_id string", "components": "components array<string>",
        "score": "score double", "ts": "ts timestamp",
    },
}


def _exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(hadoop) and (not folder or store.getFileStatus(hadoop).isDirectory())


RUN = 17  # pieces are summed up in runs of 2^RUN, whatever the size of a byte range
MOST_PIECES = 10_000  # closing braces in one record; what never ends is not gathered


def array_texts(spark: SparkSession, path: str) -> DataFrame:
    """(place, text, whole): the elements of JSON array files, read in byte ranges of any file size.

    A file is read as pieces that end at a closing brace, which Spark splits like lines. Whether a piece starts inside a string
    depends on all quotes before it, and whether its brace ends an element on all braces before it. Both are
    running sums: taken inside each run of pieces of a byte range, then over the runs (a row for each), never over the texts in one
    place. Elements that fall apart into several pieces, by nested braces or braces in strings, are put together again.

    whole is false for what no closing brace ends; there text may be null. place counts elements over all files, by name.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    split = F.split(plain, '"')
    opened = lambda odd: F.aggregate(
        F.transform(split, lambda x, i: F.when(i % 2 == odd, F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))).otherwise(0)), F.lit(0), lambda a, x: a + x
    )
    raw = spark.read.option("lineSep", "}").text(path)
    chunks = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_size").alias("bytes"),
        ((F.size(split) - 1) % 2).alias("flips"), opened(0).alias("outside"), opened(1).alias("inside"),
    )
    chunks = staged(chunks.withColumn("run", F.shiftright("at", RUN)), "pieces")
    key = ["file", "block", "run"]
    before = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda x: F.coalesce(x, F.lit(0))
    ranges = lambda rows, x: rows.groupBy(*key).agg(F.sum(x).alias("n"))

    # the last piece of a file ends at a brace only if pieces and braces fill the file
    sums = chunks.groupBy(*key).agg(F.max("at").alias("at"), F.sum(F.octet_length("value") + 1).alias("filled"), F.max("bytes").alias("bytes"))  # numbers only, so nothing is sorted for it
    last = sums.groupBy("file").agg(F.max(F.struct("block", "at")).alias("end"), (F.sum("filled") > F.max("bytes")).alias("cut"))
    chunks = chunks.join(last, "file").withColumn("cut", F.col("cut") & (F.struct("block", "at") == F.col("end"))).drop("end", "bytes")
    quoted = ranges(chunks, "flips").withColumn("quoted", none(F.sum("n").over(earlier))).drop("n")
    chunks = chunks.join(quoted, key).withColumn("quoted", (F.col("quoted") + none(F.sum("flips").over(before))) % 2)
    ends = F.when(~F.col("cut") & ((F.col("quoted") + F.col("flips")) % 2 == 0), 1).otherwise(0)
    chunks = chunks.withColumn("step", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")) - ends)
    deep = ranges(chunks, "step").withColumn("deep", none(F.sum("n").over(earlier))).drop("n")
    chunks = chunks.join(deep, key).withColumn("deep", F.col("deep") + none(F.sum("step").over(before)) + F.col("step"))
    chunks = chunks.withColumn("last", ((ends == 1) & (F.col("deep") == 0)).cast("long"))
    everywhere = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each run
    done = ranges(chunks, "last").withColumn("done", none(F.sum("n").over(everywhere))).drop("n")
    chunks = chunks.join(done, key).withColumn("place", F.col("done") + none(F.sum("last").over(before)))
    chunks = staged(chunks.select("place", *key, "at", "value", "last"), "pieces")

    # an element begun in one file and not ended there stays with that file
    own = ["place", "file"]
    sizes = chunks.groupBy(*own).agg(F.count("*").alias("n"), F.max("last").alias("whole"))
    pieces = chunks.join(sizes.where(F.col("n") <= MOST_PIECES), own)
    text = F.array_join(F.array_sort(F.collect_list(F.struct("block", "at", "value")))["value"], "}")
    texts = pieces.groupBy(*own, "whole").agg(text.alias("text")).withColumn("text", F.regexp_replace("text", r"^[\s,\[\]\ufeff]+", ""))
    endless = sizes.where(F.col("n") > MOST_PIECES).select("place", F.lit(None).cast("string").alias("text"), F.lit(False).alias("whole"))
    whole = F.col("whole") == 1
    return texts.where("whole = 1 or text <> ''").select("place", F.concat("text", F.when(whole, "}").otherwise("")).alias("text"), whole.alias("whole")).unionByName(endless)


def read_json_checked(spark: SparkSession, path: str, table: str, id_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON array files, or of a folder of JSON lines; rejects hold the text of every malformed record.

    ``seq`` is the rank by the id column, the order of generated ids; without one it is the place in the
    array file, or some increasing number for a folder of lines.
    """
    fields = JSON_FIELDS[table]
    raw = ", ".join(f"`{k}` {'decimal(18,2)' if v.endswith(' cents') else 'string' if v.endswith((' date', ' timestamp')) else v.split(' ', 1)[1]}" for k, v in fields.items())
    if _exists(spark, path, folder=True):
        lines = spark.read.option("recursiveFileLookup", True).text(path).where("trim(value) <> ''")
        texts = lines.select(F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"), F.lit(True).alias("whole"))
    else:
        texts = array_texts(spark, path)
    parsed = texts.withColumn("r", F.from_json("text", raw + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.col("whole") & F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    out = []
    for k, v in fields.items():
        name, kind = v.split(" ", 1)
        column = F.col(f"r.`{k}`")
        out.append(((column * 100).cast("long") if kind == "cents" else column.cast(kind)).alias(name))
    rows = parsed.where(good).select(*out, F.col("place").alias("seq"))
    rejects = parsed.where(~F.coalesce(good, F.lit(False))).select("place", "text")
    return (rows if id_column is None else with_seq(rows.drop("seq"), id_column)), rejects


def read_json(spark: SparkSession, path: str, table: str, id_column: str | None = None) -> DataFrame:
    """The rows of :func:`read_json_checked`, for sources whose malformed records are skipped by design."""
    return read_json_checked(spark, path, table, id_column)[0]


def with_seq(df: DataFrame, *by: str, name: str = "seq", first: int = 0) -> DataFrame:
    """Positions as rank by some columns: a range-partitioned sort, written once, then offsets per partition.

    Counting and numbering read the same written rows; a second range partitioning would draw other bounds.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))  # a row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_part", (before - F.col("first") + first).alias("_shift"))
    return ranged.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).format(kind).save(path)


def read_corrections(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """The correction log; a missing or malformed log is empty, an empty one falls back to the second path.

    The log is a folder that :func:`append_corrections` adds to, or a JSON file.
    """
    empty = spark.createDataFrame([], schemas.CORRECTIONS)
    for place in (path, fallback):
        if place and _exists(spark, place):
            rows = read_json(spark, place, "corrections")
            found = rows.where("record_id is not null and decision in ('accept', 'reject')")
            if not found.isEmpty():
                return found
    return empty


def _exchange(rows: DataFrame, table: str) -> list[Column]:
    columns = []
    for field, v in JSON_FIELDS[table].items():
        name, kind = v.split(" ", 1)
        if name in rows.columns:
            x = F.col(name)
            if kind == "cents":
                x = (x.cast("decimal(20,0)") / 100).cast("decimal(18,2)")
            elif kind == "timestamp":
                x = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
            columns.append(x.alias(field))
    return columns


def write_json(rows: DataFrame, path: str, table: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines in the exchange format; columns that it does not name stay out."""
    rows.select(*_exchange(rows, table)).write.mode(mode).json(path)


def append_corrections(rows: DataFrame, path: str, commit: str | None = None) -> None:
    """Append decisions with the time of writing, as JSON lines in the exchange format.

    commit: names this append; writing the same commit again replaces it, so a repeated one changes nothing.
    """
    stamped = rows.withColumn("ts", F.current_timestamp())
    if commit is None:
        write_json(stamped, path, "corrections", "append")
    else:
        write_json(stamped, f"{path}/commit-{commit}", "corrections", "overwrite")


def write_array(rows: DataFrame, path: str, table: str) -> None:
    """A folder of JSON array files in the exchange format, one for each partition."""
    fields = F.struct(*_exchange(rows, table))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for pdf in batches:
            yield pd.DataFrame({"value": [("[" if first and k == 0 else ",") + x for k, x in enumerate(pdf["value"])]})
            first = first and not len(pdf)
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    rows.select(F.to_json(fields).alias("value")).mapInPandas(lines, "value string").write.text(path)


def write_report(document: DataFrame, matches: DataFrame, exceptions: DataFrame, folder: str) -> None:
    write_table(matches, f"{folder}/matches")
    write_table(exceptions, f"{folder}/exceptions")
    write_table(document, f"{folder}/document", "json", "kind")
