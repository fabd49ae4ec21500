"""Temperature mixing of sources to target weights, with DataFrame functions only.

A source's share of all tokens, raised to an exponent between 0 and 1 and normalised, is its weight. The exponent is
bisected: either the largest whose weights reach a target entropy, or the smallest whose weights repeat no source
more than `repetition_limit` times. Weights become token budgets, and a budget becomes whole and partial passes over
a source, each pass in a seeded permutation of its own; the passes of all sources are cut into blocks that each hold
every source in its weight, and each block is permuted in turn. A document's place among the blocks is the mean of its
shares of the tokens and of the rows before it, so that a source of few words in few documents fills no block with all
the others. The same files and seed give the same result.

Defined cases: a null source is a source of its own; null and empty texts have no tokens, come with every pass that
reaches their place in the permutation, and a source of nothing but those takes its single pass; repeated rows are
separate documents; one source, or none, gives exponent 1; other columns are left behind unless carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.text import WORD
from quern.plans.lineage import cut
from quern.plans.prefix import bucket_bits, running_totals
from quern.plans.rows import numbered

#: Tokens that a block holds on average.
BLOCK_TOKENS = 1 << 18
#: Rows that a block of texts without tokens holds on average.
BLOCK_ROWS = 1 << 16
#: Sources up to which the table of weights (some 50 bytes each) is broadcast.
BROADCAST_SOURCES = 100_000
#: Halvings that one job settles, and jobs.
HALVINGS, ROUNDS = 5, 8


def n_tokens(text: str = "text") -> Column:
    """White-space separated words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Temperature:
    exponent: float
    #: Tokens to realise in all.
    budget: float
    #: Sum of shares raised to the exponent.
    norm: float


def source_sizes(counted: DataFrame) -> DataFrame:
    """Per source: documents and tokens. `counted` has source and tokens."""
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("n_tokens"))


def find_temperature(sizes: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget_tokens: int | None = None) -> Temperature:
    """Bisects the exponent on the per-source table; each job settles `HALVINGS` halvings by trying all their middles.

    `target_entropy` is a fraction of the largest entropy, log(sources). Without `budget_tokens` the budget is the
    least that passes over every source once. Exponent 0 where even it misses the target; 1 where 1 meets it.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either target_entropy or repetition_limit")
    used = sizes.filter("n_tokens > 0")
    total, largest, smallest, sources = used.agg(F.sum("n_tokens"), F.max("n_tokens"), F.min("n_tokens"), F.count(F.lit(1))).first()
    if not sources:
        return Temperature(1.0, 0.0, 1.0)
    share = F.col("n_tokens") / F.lit(float(total))

    def tried(exponents: list[float]) -> dict[float, tuple[float, float]]:
        grid = used.select(share.alias("p"), F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
        w = F.pow("p", "a")
        rows = grid.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log("p")).alias("zl")).collect()  # one row an exponent
        return {r["a"]: (r["z"], log(r["z"]) - r["a"] * r["zl"] / r["z"]) for r in rows}

    def budget(a: float, z: float) -> float:
        return float(budget_tokens) if budget_tokens else total * z * (largest / total) ** (1 - a)

    def meets(a: float, z: float, entropy: float) -> bool:
        if target_entropy is not None:
            return entropy >= target_entropy * log(sources) - 1e-12
        return budget(a, z) / total / z * (smallest / total) ** (a - 1) <= repetition_limit + 1e-12

    # `good` meets the target at one end; entropy asks for small exponents, a repetition limit for large ones
    ends = tried([0.0, 1.0])
    good, bad = (0.0, 1.0) if target_entropy is not None else (1.0, 0.0)
    if meets(bad, *ends[bad]):
        good = bad
    elif meets(good, *ends[good]):
        for _ in range(ROUNDS):
            middles = [good + (bad - good) * i / 2**HALVINGS for i in range(1, 2**HALVINGS)]
            found = tried(middles)
            step = (bad - good) / 2**HALVINGS
            n = max([i for i, a in enumerate(middles, 1) if meets(a, *found[a])], default=0)
            good, bad = good + step * n, good + step * (n + 1)
    z, _ = tried([good])[good]
    return Temperature(good, budget(good, z), z)


def mix(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """The mixed corpus: a row for each pass over each document that the budget reaches.

    Returns the carried columns, doc_id, source, tokens long, epoch int (pass, from 0), start long (tokens of the
    source before it), block long and slot long (gapless from 0 in its block), weight and exponent double.
    """
    if {"source", "doc_id"} & set(carry):
        raise ValueError("doc_id and source come in any case")
    docs = numbered(docs, *dict.fromkeys(["doc_id", "source", "text", *carry]))
    counted = cut(docs.select("doc_id", "source", n_tokens().alias("tokens"), "_row"))  # the texts are read no more
    sizes = cut(source_sizes(counted))
    t = find_temperature(sizes, target_entropy, repetition_limit, budget_tokens)
    sources, n, total = sizes.agg(F.count(F.lit(1)), F.sum("n_docs"), F.sum("n_tokens")).first()
    n, total = n or 0, max(1, total or 0)

    weight = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / F.lit(float(total)), F.lit(t.exponent)) / F.lit(t.norm)).otherwise(F.lit(0.0))
    budgets = sizes.select(F.col("source").alias("_s"), F.col("n_tokens").alias("_all"), F.col("n_docs").alias("_docs"), weight.alias("weight"))
    # rounding must not add a pass of nothing, nor leave out the last document of a whole one
    tokens = F.round(F.col("weight") * F.lit(t.budget)).cast("long")
    budgets = budgets.withColumn("_budget", F.when(F.abs(tokens - F.col("_all")) <= 1, F.col("_all")).otherwise(tokens))
    budgets = budgets.withColumn("_passes", F.greatest(F.lit(1), F.ceil(F.col("_budget") / F.greatest(F.lit(1), F.col("_all")))).cast("int"))
    if sources <= BROADCAST_SOURCES:
        budgets = F.broadcast(budgets)

    dealt = counted.join(budgets, F.col("source").eqNullSafe(F.col("_s")))
    dealt = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1)))
    dealt = dealt.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", "doc_id", "_row"))
    placed = running_totals(dealt.drop("_s", "_passes"), ["source", "epoch"], "_h", ["_row"], {"_in": F.col("tokens"), "_before": F.lit(1)}, bucket_bits(n))
    placed = placed.withColumn("start", F.col("epoch") * F.col("_all") + F.col("_in"))
    # a budget that ends with a pass also has the empty texts at its end
    last = (F.col("start") == F.col("_budget")) & (F.col("_budget") == (F.col("epoch") + 1) * F.col("_all"))
    placed = placed.filter((F.col("start") < F.col("_budget")) | (F.col("_all") == 0) | last)

    blocks = max(1, ceil(t.budget / block_tokens), ceil(n / BLOCK_ROWS))
    reached = placed.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_rows"))
    placed = placed.join(F.broadcast(reached) if sources <= BROADCAST_SOURCES else reached, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # by tokens, which fill blocks evenly, and by rows, of which many may share one start
    rows = (F.col("epoch") * F.col("_docs") + F.col("_before")) / F.col("_rows")
    share = F.when(F.col("_all") > 0, (F.col("start") / F.greatest(F.col("_budget"), F.lit(1)) + rows) / 2).otherwise(rows)
    block = F.least(F.lit(blocks - 1), F.floor(share * blocks))
    placed = placed.withColumn("block", block.cast("long"))
    order = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "_h"), "_row")
    placed = placed.withColumn("slot", (F.row_number().over(order) - 1).cast("long")).withColumn("exponent", F.lit(t.exponent))
    out = placed.select("doc_id", "source", "tokens", "epoch", "start", "block", "slot", "weight", "exponent", "_row")
    if not carry:
        return out.drop("_row")
    texts = docs.select(*carry, "doc_id", "_row").withColumnsRenamed({"_row": "_r", "doc_id": "_d"})
    return out.join(texts, (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select(*carry, *[c for c in out.columns if c != "_row"])
