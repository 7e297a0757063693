"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

*Weights.* A source's share of all tokens (words ``[^\\x20\\x09-\\x0D]+``) is raised to an exponent
between 0 (equal weights) and 1 (as they come) and normalised. The exponent is bisected, seven halvings
a job: each job evaluates all inner points of the bracket over the table of sources and brings a row a
point to the driver. Target: the smallest exponent at which no source is repeated more than
``repetition`` times, or the largest at which the weights' entropy is ``entropy`` at least. Without a
``budget`` of tokens, the mix is as large as it must be for every source to be used once at least; a source's own
tokens are the floor of its budget then, whatever the doubles round to.

*Permutations.* A source's budget is whole passes over its rows and a part of one more. A pass is an
order of the source's blocks (about ``BLOCK_ROWS`` rows, dealt by a hash of ``doc_id``), and of the rows
in each block, both by a hash of the pass. A row's ``token_start`` is the tokens before it in its pass:
sums over 256 groups of blocks, over the blocks of a group, and over the rows of a block, so that no
window holds a source, however large. A part of a pass is its rows that end within the rest of the
budget.

Everything is DataFrame operations. Defined results: a null source is a source of its own; a null or
empty text has no tokens and is in every pass it starts in; a source without any token has weight 0 and
one pass. A row whose ``doc_id`` is null is dealt by the MD5 of its text. Rows that repeat are dealt like others; ties
of the hash go by token count. An empty table gives an empty result. Only ``doc_id, text, source`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import materialize, packed, same, whole_text

BLOCK_ROWS = 1024
REPETITION = 2.0
SEED = "mix"
#: Bisections that one job evaluates together, and jobs: 42 halvings of the bracket in all.
HALVINGS, JOBS = 7, 6


def _number(text: Column) -> Column:
    """The first 32 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _before(name: str, over) -> Column:
    """The sum of the rows before this one."""
    return F.coalesce(F.sum(name).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def exponent(totals: DataFrame, repetition: float | None = None, entropy: float | None = None, budget: int | None = None) -> float:
    """The bisected exponent, to nine decimals; ``totals`` has ``source, tokens``."""
    whole = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    if not whole:
        return 1.0
    sources = totals.where("tokens > 0").select((F.col("tokens") / F.lit(float(whole))).alias("share"))
    low, high, parts = 0.0, 1.0, 1 << HALVINGS
    for _ in range(JOBS):
        points = F.explode(F.array(*[F.lit(low + (high - low) * k / parts) for k in range(parts + 1)]))
        at = sources.select("share", points.alias("x")).groupBy("x")
        sums = at.agg(
            F.sum(F.pow("share", "x")).alias("z"),
            F.sum(F.pow("share", "x") * F.col("x") * F.log("share")).alias("e"),
            F.max(F.pow("share", F.col("x") - 1)).alias("most"),
            F.min(F.pow("share", F.col("x") - 1)).alias("least"),
        )
        if entropy is not None:
            fits = F.log("z") - F.col("e") / F.col("z") < entropy
        elif budget is None:
            fits = F.col("most") / F.col("least") <= repetition
        else:
            fits = F.col("most") / F.col("z") * (budget / whole) <= repetition
        found = dict(sums.select("x", fits.alias("fits")).collect())
        # Monotone: false up to some point, true from there.
        first = next((x for x in sorted(found) if found[x]), None)
        if first is None:
            return high
        if first == low:
            return low
        low, high = first - (high - low) / parts, first
    return round(high, 9)


def mixture(rows: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """``source, rows, tokens, weight, budget, passes, rest, blocks`` for each source of ``rows (source, tokens)``."""
    totals = materialize(rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")), "mix-totals")
    x = exponent(totals, repetition, entropy, budget)
    whole = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    lifted = totals.withColumn("lift", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(whole)), F.lit(x))).otherwise(0.0))
    z, most = lifted.agg(F.sum("lift"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("lift")))).first() or (1.0, 0.0)
    # Tokens for each unit of lift: those of the source that needs the most, or a share of the given budget.
    given = F.round(F.col("lift") * F.lit(float(most or 0.0) if budget is None else budget / (z or 1.0))).cast("long")
    given = given if budget is not None else F.greatest("tokens", given)
    plan = lifted.withColumn("weight", F.col("lift") / F.lit(z or 1.0)).withColumn("budget", given)
    some = F.col("tokens") > 0
    return plan.select(
        "source", "rows", "tokens", "weight", "budget",
        F.when(some, F.expr("budget div tokens")).otherwise(1).cast("int").alias("passes"),
        F.when(some, F.expr("budget % tokens")).otherwise(0).cast("long").alias("rest"),
        F.ceil(F.col("rows") / BLOCK_ROWS).cast("long").alias("blocks"),
    )


def _name(docs: DataFrame) -> dict[str, Column]:
    """What the mix knows a row by, and what it is dealt by."""
    lot = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(whole_text()))
    return {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64("text"), "source": F.col("source").cast("string"), "lot_of": lot}


def _planned(docs: DataFrame, **target) -> tuple[DataFrame, DataFrame]:
    """Narrow rows, each with its source's plan and its block, and the plan of the sources."""
    words = F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = materialize(docs.select(*[e.alias(n) for n, e in _name(docs).items()], words.alias("tokens")), "mix-rows")
    plan = materialize(mixture(rows, **target).select(F.col("source").alias("p_source"), "passes", "rest", "blocks"), "mix-plan")
    used = rows.join(plan, same(F.col("source"), F.col("p_source"))).drop("p_source")
    return used.withColumn("block", _number(F.col("lot_of")) % F.col("blocks")), plan


def _starts(used: DataFrame) -> DataFrame:
    """``s_source, s_pass, s_block, block_start, n`` for each block of each pass in ``used``; ``n``: its tokens."""
    mark = F.concat_ws("|", F.lit(SEED), F.col("pass"), F.coalesce("source", F.lit("")), F.col("block"))
    used = used.withColumn("block_key", F.md5(mark)).withColumn("lot", F.substring("block_key", 1, 2))
    key = ["source", "pass"]
    blocks = materialize(used.groupBy(*key, "lot", "block_key", "block").agg(F.sum("tokens").alias("n")), "mix-blocks")
    lots = blocks.groupBy(*key, "lot").agg(F.sum("n").alias("n")).withColumn("lot_start", _before("n", Window.partitionBy(*key).orderBy("lot"))).drop("n")
    blocks = blocks.withColumn("in_lot", _before("n", Window.partitionBy(*key, "lot").orderBy("block_key", "block")))
    a, b = blocks.alias("a"), lots.alias("b")
    starts = a.join(b, [same(F.col(f"a.{n}"), F.col(f"b.{n}")) for n in [*key, "lot"]])
    starts = starts.select(F.col("a.source").alias("s_source"), F.col("a.pass").alias("s_pass"), F.col("a.block").alias("s_block"), (F.col("in_lot") + F.col("lot_start")).alias("block_start"), "n")
    return materialize(starts, "mix-starts")


def _in_order(used: DataFrame, *ties: str) -> DataFrame:
    """``used`` with ``in_block``: the tokens of its block's rows before it in its pass."""
    order = Window.partitionBy("source", "pass", "block").orderBy(F.md5(F.concat_ws("|", F.lit(SEED), F.col("pass"), F.col("lot_of"))), "tokens", *ties)
    return used.withColumn("in_block", _before("tokens", order))


def _at(starts: DataFrame) -> list[Column]:
    return [same(F.col("source"), starts["s_source"]), F.col("pass") == starts["s_pass"], F.col("block") == starts["s_block"]]


def permutations(docs: DataFrame, **target) -> DataFrame:
    """``doc_id, source, pass, block, token_start, tokens``: a row for each use of a document."""
    used, _ = _planned(docs, **target)
    last = F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    used = used.where(last >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
    starts = _starts(used)
    met = _in_order(used).join(starts, _at(starts))
    met = met.withColumn("token_start", F.col("block_start") + F.col("in_block"))
    met = met.where((F.col("pass") < F.col("passes")) | (F.col("token_start") + F.col("tokens") <= F.col("rest")))
    return met.select("doc_id", "source", "pass", "block", "token_start", "tokens")


def mix(docs: DataFrame, **target) -> DataFrame:
    """``docs`` with each row as often as :func:`permutations` uses it.

    Texts meet narrow tables only: the plan of the sources; the blocks that the part of a pass takes whole (all
    their rows get one more use); and the rows of the one block a source that the rest of the budget ends in.
    Of rows that repeat there, of which the part takes some, one carries what the part takes.
    """
    used, plan = _planned(docs, **target)
    part = used.where("rest > 0").withColumn("pass", F.col("passes"))
    starts = _starts(part)
    taken = starts.join(plan, same(F.col("s_source"), F.col("p_source"))).where("block_start <= rest")
    taken = taken.withColumn("whole", F.col("block_start") + F.col("n") <= F.col("rest"))
    taken = materialize(taken.select("s_source", "s_pass", "s_block", "block_start", "whole"), "mix-taken")
    cut = taken.where("not whole")
    edge = _in_order(part.join(cut, _at(cut)), "text_hash")
    fits = F.when(F.col("block_start") + F.col("in_block") + F.col("tokens") <= F.col("rest"), 1).otherwise(0)
    name = ["doc_id", "text_hash", "source"]
    edge = edge.groupBy(*name).agg(F.sum(fits).alias("k"), F.count("*").alias("n")).where("k > 0")
    edge = materialize(edge.select(*[F.col(c).alias(f"e_{c}") for c in name], "k", (F.col("k") == F.col("n")).alias("every")), "mix-edge")
    is_edge = [same(F.col(c), F.col(f"e_{c}")) for c in name]

    rows = packed(docs, **_name(docs))
    all_ = rows.join(plan, same(F.col("source"), F.col("p_source"))).withColumn("block", _number(F.col("lot_of")) % F.col("blocks"))
    whole = taken.where("whole").select("s_source", "s_block", F.lit(1).alias("more"))
    all_ = all_.join(whole, [same(F.col("source"), F.col("s_source")), F.col("block") == F.col("s_block")], "left")
    all_ = all_.join(edge.where("every").withColumn("one", F.lit(1)), is_edge, "left")
    uses = F.col("passes") + F.coalesce("more", "one", F.lit(0))
    all_ = all_.select("row", uses.alias("uses")).where("uses > 0")
    some = rows.join(edge.where("not every"), is_edge).dropDuplicates(name).select("row", F.col("k").cast("int").alias("uses"))
    out = all_.unionByName(some).select("row", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("use"))
    return out.select("row.*")
