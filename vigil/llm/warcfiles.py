"""WARC files as a Spark source: records of any type, by splits, plain or gzip.

Spark's text source cuts a file at ``\\r\\n\\r\\nWARC/``, the end of a record and the start of the next, so a plain
file is read by as many tasks as it has splits, and a gzip file (one member, or a member a record) by one.
``Content-Length`` then decides: a piece whose block has that length is a record. A payload may hold the
separator itself (an archive in an archive); its record comes in several pieces, the first shorter than its
length says. Only files with such a piece take a second way: their pieces are written, the narrow list of piece lengths
of a file (never its bytes) is walked in order, and the pieces of a cut record are put together again.

Defined results: a record whose bytes end early, or whose length is missing or wrong, has ``whole`` false and the bytes
that are there. Field names in any case and folded lines are read; of a field that repeats, the first counts. Bytes
stay as they are, valid UTF-8 or not. An empty file has no records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import materialize

END = "\r\n"
SEPARATOR = END * 2 + "WARC/"


def field(head: Column, name: str) -> Column:
    """The value of a header field, null if it is missing."""
    unfolded = F.regexp_replace(head, "\r\n[ \t]+", " ")
    pattern = rf"(?i)(?:^|\n){name.replace('-', '[-]')}[ \t]*:[ \t]*([^\r\n]*)"
    value = F.trim(F.regexp_extract(unfolded, pattern, 1))
    return F.when(F.length(value) > 0, value)


def _parsed(pieces: DataFrame) -> DataFrame:
    """``head``, ``block`` and ``size`` (the declared length) of each piece's ``value``."""
    raw = F.col("value").cast("binary")
    start = F.octet_length("head") + 5
    length = F.try_to_number(field(F.col("head"), "Content-Length"), F.lit("9" * 18)).cast("long")
    made = pieces.withColumn("head", F.substring_index("value", END * 2, 1)).withColumn("size", length)
    block = F.substring(raw, start, F.octet_length("value"))
    # The file's last record keeps its two line ends.
    last = (F.octet_length(block) == F.col("size") + 4) & (F.substring(block, F.col("size").cast("int") + 1, F.lit(4)) == F.lit((END * 2).encode()))
    block = F.when(last, F.substring(block, F.lit(1), F.col("size").cast("int"))).otherwise(block)
    made = made.withColumn("block", block)
    return made.withColumn("whole", F.coalesce(F.octet_length("block") == F.col("size"), F.lit(False)))


def _owners(pieces: pd.DataFrame) -> pd.DataFrame:
    """For each piece of a file, the piece that its record starts with."""
    pieces = pieces.sort_values(["split", "no"])
    out, at, end, owner = [], 0, 0, 0
    for no, length, need in zip(pieces["no"].tolist(), pieces["length"].tolist(), pieces["need"].tolist(), strict=True):
        if at >= end:  # not inside the record before
            owner, end = no, at + need
        out.append(owner)
        at += length + len(SEPARATOR)
    return pd.DataFrame({"file": pieces["file"], "no": pieces["no"], "owner": out})


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, head, block, whole`` for each record of the WARC files in ``path``."""
    text = spark.read.option("lineSep", SEPARATOR).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    # Only a file's first piece still has its first letters.
    pieces = pieces.withColumn("value", F.when(F.startswith("value", F.lit("WARC/")), F.expr("substr(value, 6)")).otherwise(F.col("value")))
    pieces = pieces.where(F.length(F.trim(F.regexp_replace("value", r"[\r\n]", ""))) > 0)
    columns = ["file", "head", "block", "whole"]
    cut = materialize(_parsed(pieces).where(~F.col("whole")).select("file").distinct(), "warc-cut")
    if cut.isEmpty():
        return _parsed(pieces).select(*columns)
    fine = _parsed(pieces.join(cut, "file", "left_anti")).select(*columns)
    rest = materialize(pieces.join(cut, "file", "left_semi").withColumn("no", F.monotonically_increasing_id()), "warc-pieces")
    need = F.octet_length("head") + 4 + F.coalesce("size", F.lit(0))
    narrow = _parsed(rest).select("file", "split", "no", F.octet_length("value").cast("long").alias("length"), need.cast("long").alias("need"))
    owners = materialize(narrow.groupBy("file").applyInPandas(_owners, "file string, no long, owner long"), "warc-owners")
    joined = rest.join(owners, ["file", "no"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("no", "value"))).alias("parts"))
    again = joined.select("file", F.array_join(F.transform("parts", lambda p: p["value"]), SEPARATOR).alias("value"))
    return fine.unionByName(_parsed(again).select(*columns))


def read_responses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The whole response records in the columns of :func:`vigil.llm.warc.responses`; ``payload`` is binary.

    Identifier, target, date and payload digest are the record's own; a digest that is missing is made. ``page_id`` is
    the extension field ``X-Page-ID``, null without it. A block without an empty line is all headers.
    """
    records = read_records(spark, path).where("whole").where(F.lower(field(F.col("head"), "WARC-Type")) == "response")
    http = F.substring_index(F.col("block").cast("string"), END * 2, 1)
    made = records.select("head", "block", http.alias("http"))
    payload = F.substring(F.col("block"), F.octet_length("http") + 5, F.octet_length("block"))
    own = lambda name: field(F.col("head"), name)
    return made.select(
        own("X-Page-ID").cast("long").alias("page_id"), own("WARC-Record-ID").alias("record_id"), own("WARC-Target-URI").alias("target_uri"),
        own("WARC-Date").alias("date"), F.substring_index("http", END, 1).alias("http_status"),
        F.when(F.contains("http", F.lit(END)), F.expr("substr(http, instr(http, '\\r\\n') + 2)")).otherwise("").alias("http_headers"),
        payload.alias("payload"), F.coalesce(own("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), F.sha2(payload, 256))).alias("payload_digest"),
    )
