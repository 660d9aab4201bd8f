"""Life cycles of a technology: yearly counts with applicants, a logistic curve through the running total, region shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 60
#: Shares of the curve's height at which a technology leaves its emergence, its growth and its maturity.
STAGES = {"emergence": 0.1, "growth": 0.5, "maturity": 0.9}


def yearly(df: DataFrame, by: list[str], year: str, applicant: str) -> DataFrame:
    """by, year, n, applicants, total (running, of all years so far) for every year with rows."""
    per = df.groupBy(*by, year).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(applicant).alias("applicants"))
    return per.withColumn("total", F.sum("n").over(Window.partitionBy(*by).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)))


def _sum(points: Column, f) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p))


def s_curve(counts: DataFrame, by: list[str], year: str = "year", total: str = "total", rounds: int = ROUNDS) -> DataFrame:
    """by, years, top, rate, middle, sse, stage: the logistic top / (1 + exp(-rate * (year - middle))) with the least squares to the running totals.

    Gauss-Newton with damping: each round solves for a step from sums over the years, takes it if the squares fall and is
    bolder for it, else more careful.  A group's years are one short list, so all groups are fitted in one pass without a shuffle per round.
    Groups of fewer than four years have no curve.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(year).cast("double").alias("t"), F.col(total).cast("double").alias("y"))))
    rows = counts.where(F.col(total).isNotNull() & F.col(year).isNotNull()).groupBy(*by).agg(points.alias("p"))

    def value(s, t):
        return s["k"] / (1 + F.exp(-s["r"] * (t - s["m"])))

    def squares(p, s):
        return _sum(p, lambda x: (x["y"] - value(s, x["t"])) * (x["y"] - value(s, x["t"])))

    def start(p):
        last = F.element_at(p, -1)
        spread = F.greatest(last["t"] - p[0]["t"], F.lit(1.0))
        half = F.get(F.filter(p, lambda x: x["y"] * 2 >= last["y"]), F.lit(0))["t"]
        guess = F.struct((last["y"] * 1.2).alias("k"), (F.lit(4.0) / spread).alias("r"), half.alias("m"))
        return F.struct(guess["k"].alias("k"), guess["r"].alias("r"), guess["m"].alias("m"), F.lit(1e-2).alias("damp"), squares(p, guess).alias("sse"))

    def step(p, s):
        def slopes(x):
            e = F.exp(-s["r"] * (x["t"] - s["m"]))
            d = 1 + e
            return [1 / d, s["k"] * (x["t"] - s["m"]) * e / (d * d), -s["k"] * s["r"] * e / (d * d), x["y"] - s["k"] / d]

        names = [(i, j) for i in range(3) for j in range(i, 4)]
        sums = F.aggregate(p, F.struct(*[F.lit(0.0).alias(f"s{i}{j}") for i, j in names]), lambda a, x: _added(a, slopes(x), names))

        def solve(a):
            at = lambda i, j: a[f"s{min(i, j)}{max(i, j)}"] * ((1 + s["damp"]) if i == j else 1.0)
            b = [a[f"s{i}3"] for i in range(3)]
            det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
            m = [[at(i, j) for j in range(3)] for i in range(3)]
            whole = det(m)
            put = lambda c: [[b[i] if j == c else m[i][j] for j in range(3)] for i in range(3)]
            go = [F.try_divide(det(put(c)), whole) for c in range(3)]
            new = F.struct((s["k"] + go[0]).alias("k"), (s["r"] + go[1]).alias("r"), (s["m"] + go[2]).alias("m"))
            return F.transform(F.array(new), lambda n: F.struct(n["k"].alias("k"), n["r"].alias("r"), n["m"].alias("m"), squares(p, n).alias("sse")))[0]

        def judged(n):
            good = F.coalesce((n["sse"] < s["sse"]) & (n["k"] > 0), F.lit(False)) & ~F.isnan(n["sse"])
            pick = lambda f: F.when(good, n[f]).otherwise(s[f]).alias(f)
            return F.struct(pick("k"), pick("r"), pick("m"), F.when(good, F.greatest(s["damp"] / 3, F.lit(1e-12))).otherwise(F.least(s["damp"] * 5, F.lit(1e12))).alias("damp"), pick("sse"))

        # each part is bound once and used by name
        return F.transform(F.transform(F.array(sums), solve), judged)[0]

    # bounds growing copies of the plan: the rounds are one fold over a list of numbers
    fit = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start(F.col("p")), lambda s, i: step(F.col("p"), s))
    fitted = rows.select(*by, F.size("p").alias("years"), F.when(F.size("p") >= 4, fit).alias("f"), F.element_at("p", -1).alias("last"))
    share = F.col("last.y") / F.col("f.k")
    stage = reduce(lambda c, x: c.when(share < x[1], x[0]), list(STAGES.items())[1:], F.when(share < STAGES["emergence"], "emergence")).otherwise("saturation")
    return fitted.select(*by, "years", F.col("f.k").alias("top"), F.col("f.r").alias("rate"), F.col("f.m").alias("middle"), F.col("f.sse").alias("sse"), F.when(F.col("f").isNotNull(), stage).alias("stage"))


def _added(a, x, names):
    """The sums with a point's products; x: three slopes and the residual."""
    return F.struct(*[(a[f"s{i}{j}"] + x[i] * x[j]).alias(f"s{i}{j}") for i, j in names])


def region_share(df: DataFrame, by: list[str], region: str, without: list[str] | None = None) -> DataFrame:
    """by, region, n, share of its group, and share_without: the same where the regions in ``without`` don't count (null for those)."""
    n = df.groupBy(*by, region).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    left = ~F.coalesce(F.col(region).isin(without or []), F.lit(False))
    rest = F.sum(F.when(left, F.col("n"))).over(w)
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("share_without", F.when(left, F.round(F.col("n") / rest, 6)))
