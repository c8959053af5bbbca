"""Telemetry reports and paired evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

# Weights of the evaluation's five dimensions.
WEIGHTS = {"discovery": 0.30, "precision": 0.25, "completeness": 0.20, "relational": 0.15, "confidence": 0.10}


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, percent): counts and shares of all, in per cent to one digit."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("_total"), 1).alias("percent"))


def scorer_average(ratings: Column) -> Column:
    """Median of three ratings, mean of two, else the first."""
    s = F.array_sort(ratings)
    return F.when(F.size(s) == 3, F.get(s, F.lit(1)).cast("double")).when(F.size(s) == 2, (F.get(s, F.lit(0)) + F.get(s, F.lit(1))) / 2.0).otherwise(F.get(ratings, F.lit(0)).cast("double"))


def weighted(scores: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [scores[d] * F.lit(w) for d, w in WEIGHTS.items()])


def winner(a: Column, b: Column, complete_a: Column, complete_b: Column) -> Column:
    """The higher score, then the more complete, else tie."""
    return F.when(a > b, "a").when(b > a, "b").when(complete_a > complete_b, "a").when(complete_b > complete_a, "b").otherwise("tie")


def noise_probability(wins: Column, n: Column) -> Column:
    """Chance of at least `wins` heads in n fair throws."""
    # C(n, k) by multiplication; sums of k from wins to n.
    choose = lambda k: F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, i: a * (n - k + i) / i)
    return F.aggregate(F.sequence(wins, n), F.lit(0.0), lambda a, k: a + choose(k)) / F.pow(F.lit(2.0), n)


# Escalation rates: floor and ceiling of the gate, edges of the target; the most noise; least averages and wins of
# verdicts; the margin and the chance at which a paired difference counts, the least pairs to test.
FLOOR, TARGET_LOW, TARGET_HIGH, CEILING = 0.05, 0.15, 0.25, 0.55
NOISE = 0.30
SHIP, SHIP_WINS, ITERATE, ITERATE_WINS = 3.66, 7, 3.30, 6
MARGIN, CHANCE, LEAST_PAIRS = 0.20, 0.10, 6


def stability(wins: Column, n: Column, flip_rate: float) -> Column:
    """Struct win_margin, p_noise, flag: how likely fair throws give as wide a margin either way, by the rate at which tests flip."""
    margin = F.abs(2 * wins - n)
    if flip_rate <= 0:
        return F.struct(margin.cast("int").alias("win_margin"), F.lit(0.0).alias("p_noise"), F.lit("CONFIDENT").alias("flag"))
    least = F.floor((n + margin) / 2).cast("int")
    p = F.least(2 * noise_probability(least, n), F.lit(1.0)) * min(flip_rate / 0.5, 1.0)
    p = F.when(n == 0, 0.0).otherwise(p)
    return F.struct(margin.cast("int").alias("win_margin"), F.round(p, 4).alias("p_noise"), F.when(p > NOISE, "LOW CONFIDENCE").otherwise("CONFIDENT").alias("flag"))


def rate_band(rate: Column) -> Column:
    """Where an escalation rate lies: out of the gate, beside the target or in it."""
    return F.when(rate > CEILING, "ABOVE CEILING").when(rate > TARGET_HIGH, "ABOVE TARGET").when(rate < FLOOR, "BELOW FLOOR").when(rate < TARGET_LOW, "BELOW TARGET").otherwise("IN TARGET RANGE")


def gate(rate: Column) -> Column:
    """Whether a rate is within floor and ceiling; no rate passes."""
    return F.coalesce(rate.between(FLOOR, CEILING), F.lit(True))


def ranked_sums(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n_nonzero, w_plus, w_minus, ties (sum of t^3 - t over equal differences), margin (mean of a - b).

    Ranks are taken on distinct differences, dealt out by range: each range adds up its own, and an offset for the ranges before
    it. No task sees all of them, whatever their number.
    """
    d = pairs.select((F.col(a) - F.col(b)).alias("d"))
    sizes = d.where(F.round("d", 9) != 0).groupBy(F.round(F.abs("d"), 9).alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("pos"))
    dealt = sizes.repartitionByRange("m").withColumn("p", F.spark_partition_id()).persist()
    offsets = dealt.groupBy("p").agg(F.sum("n").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(offsets.select("p", "before")), "p").withColumn("r", F.col("before") + F.col("inside") + (F.col("n") + 1) / 2.0)
    n = F.col("n").cast("double")
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_nonzero"), F.coalesce(F.sum(F.col("r") * F.col("pos")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("r") * (F.col("n") - F.col("pos"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(n * n * n - n), F.lit(0.0)).alias("ties"),
    )
    return sums.crossJoin(F.broadcast(d.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("margin"))))


# A rational approximation of the error function (Abramowitz and Stegun 7.1.26), good to 1.5e-7.
ERF = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal exceeds z >= 0."""
    x = z / 2**0.5
    t = 1 / (1 + ERF[0] * x)
    poly = F.lit(0.0)
    for c in reversed(ERF[1]):
        poly = (poly + c) * t
    return 0.5 * poly * F.exp(-x * x)


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n_nonzero, w_plus, w_minus, margin, p_value, passes: a signed-rank test of a over b, one-sided.

    The chance is that of the normal approximation, corrected for ties. With fewer than six differences there is none, and the
    margin alone decides.
    """
    s = ranked_sums(pairs, a, b)
    n = F.col("n_nonzero").cast("double")
    deviation = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    z = F.abs(F.least("w_plus", "w_minus") - n * (n + 1) / 4) / deviation
    tail = normal_tail(z)
    p = F.when((F.col("n_nonzero") >= LEAST_PAIRS) & (deviation > 0), F.when(F.col("margin") > 0, tail).otherwise(1 - tail))
    return s.select("n_nonzero", "w_plus", "w_minus", "margin", p.alias("p_value")).withColumn("passes", (F.coalesce(F.col("p_value"), F.lit(1.0)) < CHANCE) | (F.col("margin") > MARGIN))


def verdict(results: DataFrame, rate: Column | None = None, tested: DataFrame | None = None) -> DataFrame:
    """One row: verdict, overall, track_a, track_b, wins_a, wins_b of results (track, score, winner; winner a is ours).

    By averages and wins; a rate out of the gate kills, and what would ship but fails the paired test (passes) goes on.
    """
    mean = lambda t: F.coalesce(F.avg(F.when(F.col("track") == t, F.col("score"))), F.lit(0.0))
    won = lambda t: F.count_if((F.col("track") == t) & (F.col("winner") == "a"))
    s = results.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("overall"), mean("A").alias("track_a"), mean("B").alias("track_b"), won("A").alias("wins_a"), won("B").alias("wins_b"))
    s = s.crossJoin(F.broadcast(tested.select("passes"))) if tested is not None else s.withColumn("passes", F.lit(True))
    wins = F.col("wins_a") + F.col("wins_b")
    first = F.when((F.col("overall") >= SHIP) & (wins >= SHIP_WINS) & (F.col("track_a") >= SHIP), "Ship").when((F.col("overall") >= ITERATE) & (wins >= ITERATE_WINS), "Iterate").otherwise("Kill")
    held = F.when(gate(rate), first).otherwise("Kill") if rate is not None else first
    final = F.when((held == "Ship") & ~F.col("passes"), "Iterate").otherwise(held)
    return s.select(final.alias("verdict"), "overall", "track_a", "track_b", "wins_a", "wins_b")


def marginal(results: DataFrame) -> DataFrame:
    """(query, total, novel, share): of results (query, file_path, source) the files that only grep found, over all results."""
    files = results.groupBy("query", "file_path").agg(F.count("*").alias("n"), F.bool_and(F.col("source") == "grep").alias("only"))
    return files.groupBy("query").agg(F.sum("n").alias("total"), F.count_if("only").alias("novel")).withColumn("share", F.col("novel") / F.col("total"))


def marginal_report(shares: DataFrame) -> DataFrame:
    """One row: queries, mean share, per cent of queries with novel files, and what that says."""
    s = shares.agg(F.count("*").alias("queries"), F.coalesce(F.avg("share"), F.lit(0.0)).alias("mean"), F.coalesce(F.avg(F.when(F.col("novel") > 0, 100.0).otherwise(0.0)), F.lit(0.0)).alias("with_novel"))
    return s.withColumn("advisory", F.when(F.col("queries") == 0, "no escalated queries").when(F.col("mean") < 0.10, "mostly noise").when(F.col("mean") > 0.50, "semantic incomplete").otherwise("healthy range"))


def blinded(test: Column, seed: int) -> Column:
    """Which side is shown as alpha in a test: the same for one seed, and even over tests."""
    return F.when(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), test.cast("string"))), 1, 1), 16, 10).cast("int") < 8, "a").otherwise("b")


def transcript(messages: DataFrame, by: str, order: str) -> DataFrame:
    """messages (by, order, role, text, tool, arguments) with line, the readable form, and calls, how many tools were called up to it.

    An assistant's message is followed by its call, if any; what others say is a result, cut at 3,000 letters.
    """
    called = (F.col("role") == "assistant") & F.col("tool").isNotNull()
    n = F.sum(F.when(called, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order))
    said = F.concat(F.lit("\n### Assistant\n\n"), "text", F.lit("\n"))
    got = F.concat(F.lit("\n**Tool Result:**\n```\n"), T.shortened(F.col("text"), 3000, "\n... [truncated]"), F.lit("\n```\n"))
    line = F.concat(F.when(F.col("role") == "assistant", said).otherwise(got), F.when(called, T.tool_call(F.col("tool"), F.col("arguments"), F.col("calls"))).otherwise(""))
    return messages.withColumn("calls", n).withColumn("line", line)
