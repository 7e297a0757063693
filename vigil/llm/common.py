"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import session
from vigil.session import materialize
from vigil.sources.tables import read_table

__all__ = ["documents", "existing", "materialize", "read_table", "same", "ship_package", "whole_text"]

#: The columns of the documents table, in order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows that Spark hands to a Python worker at once; its default suits short rows, not whole texts.
BATCH_ROWS = 1000
#: Bits of the sieve that clears rows of a meeting, and of one of Spark's bitmaps.
SIEVE_BITS, _BITMAP = 1 << 26, 1 << 15
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and hand them texts in small batches.

    A batch size that was set for the session stays as it is.
    """
    session.ship_package(spark)
    if spark.conf.get(_ROWS) == "10000" and not spark.sparkContext.getConf().contains(_ROWS):
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def existing(df: DataFrame, names: list[str]) -> list[str]:
    """Those of ``names`` that ``df`` has, in the given order."""
    return [n for n in names if n in df.columns]


def whole_text(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def same(a: Column, b: Column) -> Column:
    """Equality that also holds between nulls."""
    return a.eqNullSafe(b)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """``row``, all columns of ``docs`` as one struct, and the expressions ``more`` over them.

    Inside the struct no name of ``docs`` (with a dot, or one that an operator uses too) meets another;
    ``select("row.*")`` brings the columns back as they were.
    """
    cells = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*cells).alias("row"), *[e.alias(n) for n, e in more.items()])


def sieved(rows: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose key ``k_<name>`` is surely not in ``keys``, and those that must meet it.

    The keys' hashes set bits of a sieve of ``SIEVE_BITS``, which is broadcast (8 MB at most, whatever the table):
    no row of ``keys`` is missed, and others that pass only cost a meeting.
    """

    def spot(of: list[str]) -> Column:
        return F.pmod(F.xxhash64(*[F.col(n).cast("string") for n in of]), F.lit(SIEVE_BITS))

    bits = keys.select(spot(names).alias("spot")).groupBy(F.expr(f"spot div {_BITMAP}").alias("s_part"))
    bits = F.broadcast(materialize(bits.agg(F.bitmap_construct_agg(F.col("spot") % _BITMAP).alias("s_bits")), "sieve"))
    at = rows.withColumn("s_spot", spot([f"k_{n}" for n in names]))
    at = at.join(bits, F.expr(f"s_spot div {_BITMAP}") == F.col("s_part"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(s_bits, cast(s_spot % {_BITMAP} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.expr("cast(s_spot % 8 as int)")) == 1, F.lit(False))
    return at.where(~hit).select(*rows.columns), at.where(hit).select(*rows.columns)


def drop_rows(docs: DataFrame, key: dict[str, Column], dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped``, and with one row of each key in ``repeated``.

    ``key`` maps names to expressions over ``docs``; both tables hold those names and no common key.
    What stays is told by a sieve where it lies; only the rows that the sieve does not clear are shuffled, by the same
    plan at any size, so the disk grows with what goes.
    """
    rows = packed(docs, **{f"k_{n}": e for n, e in key.items()})

    def on(other: DataFrame) -> tuple[DataFrame, list[Column]]:
        other = other.select(*[F.col(n).alias(f"c_{n}") for n in key])
        return other.hint("shuffle_hash"), [same(F.col(f"k_{n}"), F.col(f"c_{n}")) for n in key]

    goes = dropped.select(*key).unionByName(repeated.select(*key))
    clear, met = sieved(rows, goes, list(key))
    alone = met.join(*on(goes), "left_anti")
    one = met.join(*on(repeated), "left_semi").dropDuplicates([f"k_{n}" for n in key])
    return clear.unionByName(alone).unionByName(one).select("row.*")
