"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are the token shares of the sources to the power of an exponent, which
bisection sets so that the weights have a given entropy, or no source is read
more often than a limit. A source's budget of tokens is then a number of epochs:
every whole epoch is a permutation of the source's blocks of documents, and the
last one takes blocks in permuted order, and documents in the block where the
budget ends. A block's place is its hash, so a source's plan is a few numbers,
and no text is shuffled where the table of plans is small enough for Spark to
broadcast it. Sources are a table throughout, and a source of n documents has
about sqrt(n) blocks: neither their number nor their size meets a limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import met, table, written

#: Characters of a run without blanks that count as one token.
TOKEN = 16
#: Exponents that are tried in one pass over the sources, and passes: together 48 halvings.
TRIED, PASSES = 64, 8


def token_count(text: Column) -> Column:
    """Runs of other characters than blanks, tabs and line ends, in pieces of TOKEN at most; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]{1,%d}" % TOKEN)), F.lit(0)).cast("long")


def bisect(holds: Callable[[list[float]], list[bool]], low: float, high: float) -> float:
    """The smallest value between low and high for which holds() is true, as it is at high; TRIED values are asked at once."""
    if holds([low])[0]:
        return low
    for _ in range(PASSES):
        step = (high - low) / TRIED
        tried = [low + step * k for k in range(1, TRIED)]
        first = next((x for x, yes in zip(tried, holds(tried), strict=True) if yes), high)
        low, high = first - step if first != high else tried[-1], first
    return high


class Temperature:
    """Weights (tokens / most tokens) ** exponent / total of a table of sources with `tokens`; sources without tokens have none."""

    def __init__(self, sources: DataFrame):
        self.sources = sources.where("tokens > 0")
        ends = self.sources.agg(F.max("tokens").alias("top"), F.min("tokens").alias("low")).collect()[0]
        self.top, self.low = int(ends["top"] or 1), int(ends["low"] or 1)
        self.share = F.ln(F.col("tokens") / self.top)

    def sums(self, exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent the sum of the raw weights, and of these times the logarithm of the share."""
        each = self.sources.select(self.share.alias("u"), F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "x")).select("k", "u", F.exp(F.col("x") * F.col("u")).alias("w"))
        got = {r["k"]: (r["s"], r["e"]) for r in each.groupBy("k").agg(F.sum("w").alias("s"), F.sum(F.col("u") * F.col("w")).alias("e")).collect()}
        return [got.get(k, (1.0, 0.0)) for k in range(len(exponents))]

    def entropies(self, exponents: list[float]) -> list[float]:
        return [math.log(s) - x * e / s for x, (s, e) in zip(exponents, self.sums(exponents), strict=True)]

    def budget(self, exponent: float, total: float) -> float:
        """The least budget at which every source is read whole."""
        return total * max(self.top, self.top * (self.low / self.top) ** (1 - exponent))

    def most_epochs(self, exponents: list[float], budget: float | None) -> list[float]:
        """How often the source that is read most often is read."""
        out = []
        for x, (s, _) in zip(exponents, self.sums(exponents), strict=True):
            b = self.budget(x, s) if budget is None else budget
            out.append(b / (s * self.top) * max(1.0, (self.low / self.top) ** (x - 1)))
        return out

    def exponent(self, target_entropy: float | None = None, max_epochs: float | None = None, budget: float | None = None) -> float:
        """The exponent that meets the target: entropy at most the target (or the largest exponent), or the flattest within the limit (or 1)."""
        if (target_entropy is None) == (max_epochs is None):
            raise ValueError("give target_entropy or max_epochs")
        if target_entropy is not None:
            return bisect(lambda xs: [h <= target_entropy for h in self.entropies(xs)], 0.0, 64.0)
        return bisect(lambda xs: [m <= max_epochs for m in self.most_epochs(xs, budget)], 0.0, 1.0)

    def epochs(self, exponent: float, budget: float | None) -> Column:
        """How often each source is read, as a column of the sources; those without tokens once."""
        total = self.sums([exponent])[0][0]
        b = self.budget(exponent, total) if budget is None else budget
        return F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * self.share) / total * b / F.col("tokens")).otherwise(F.lit(1.0))


def _unit(*parts: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") / float(1 << 53)


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_epochs: float | None = None,
    budget: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs, each row as often as its source's epochs say, with `epoch` and `turn`.

    `turn`, from 0 to 1, is a row's place in its source's permuted epochs; rows
    in order of it are mixed at the weights throughout. Without a budget no
    document is left out. Null sources are one source; rows without tokens come
    once; repeated rows are taken together, so a budget ends before a group of
    equal rows that would exceed it. Columns named epoch or turn are replaced;
    an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in ("epoch", "turn")]
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    # a source by a name that is never null
    name = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n"))
    lean = written(docs.select(name.alias("name"), key.alias("key"), token_count(F.col(f"`{text_col}`")).alias("tokens")))
    sources = written(lean.groupBy("name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    heat = Temperature(sources)
    exponent = heat.exponent(target_entropy, max_epochs, budget)
    nearly = F.round(heat.epochs(exponent, budget), 9)
    plan = sources.withColumn("epochs", nearly).withColumn("whole", F.floor("epochs").cast("int")).withColumn("rest", (F.col("epochs") - F.col("whole")) * F.col("tokens"))
    plan = written(plan.withColumn("blocks", F.pow(F.lit(2.0), F.ceil(F.log2("n") / 2)).cast("long")).select("name", "n", "epochs", "whole", "rest", "blocks"))

    def place(epoch: Column) -> Column:
        return _unit(F.lit(seed + 1), F.col("name"), epoch, F.col("block"))

    # the block in which the budget of the last, broken epoch ends, and what is left for it
    dealt = met(lean, plan, ["name"], ["key"]).withColumn("block", F.pmod(F.col("key"), F.col("blocks"))).where("rest > 0")
    blocks = dealt.groupBy("name", "block", "whole", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("at", place(F.col("whole")))
    up_to = F.sum("tokens").over(Window.partitionBy("name").orderBy("at", "block"))
    ends = blocks.withColumn("sum", up_to).where("sum > rest").groupBy("name").agg(F.min_by(F.struct("at", "block", (F.col("rest") - F.col("sum") + F.col("tokens")).alias("left")), F.struct("at", "block")).alias("x"))
    broken = written(ends.select("name", "x.*"))
    # within it, documents in order of their keys; equal keys go together
    edge = dealt.select("name", "block", "key", "tokens").join(broken.select("name", "block", "left"), ["name", "block"])
    last = edge.withColumn("sum", F.sum("tokens").over(Window.partitionBy("name").orderBy("key"))).where("sum <= left").groupBy("name").agg(F.max("key").alias("last"))
    limits = written(plan.join(broken.select("name", "at", F.col("block").alias("end")), "name", "left").join(last, "name", "left"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), name.alias("name"), key.alias("key"), (token_count(F.col(f"`{text_col}`")) == 0).alias("bare"))
    rows = met(own, limits, ["name"], ["key"]).withColumn("block", F.pmod(F.col("key"), F.col("blocks")))
    here = place(F.col("whole"))
    in_end = (F.col("block") == F.col("end")) & (F.col("key") <= F.col("last"))
    before = (here < F.col("at")) | ((here == F.col("at")) & (F.col("block") < F.col("end")))
    # without an end the broken epoch has all blocks, or there is none
    in_last = F.when(F.col("at").isNull(), F.col("rest") > 0).otherwise(before | F.coalesce(in_end, F.lit(False)))
    times = F.when(F.col("bare"), F.lit(1)).otherwise(F.col("whole") + in_last.cast("int"))
    many = rows.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    inside = (place(F.col("epoch")) * (F.col("blocks") - 1) + _unit(F.lit(seed + 2), F.col("key"))) / F.col("blocks")
    turn = F.least((F.col("epoch") + inside) / F.greatest(F.col("epochs"), F.lit(1e-12)), F.lit(1.0))
    return many.select(*[F.col("row")[c].alias(c) for c in kept], F.col("epoch"), turn.alias("turn"))


#: How often the query and the pipeline read a source at most.
MAX_EPOCHS = 2.0


def op3_mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_epochs=MAX_EPOCHS)
    return mixed.select("doc_id", "source", "epoch", "turn")
