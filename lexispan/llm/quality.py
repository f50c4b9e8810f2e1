"""Operator 4: quality rules by robust multivariate outliers, in DataFrame functions only.

Base rules first: too few words, or too many words in repeated five-word windows. The rest is judged
by Mahalanobis distance from a minimum-covariance-determinant estimate of its language and source.

Each group is estimated from several deterministic starts: medians with absolute deviations, and with
the covariances of values drawn in by tanh and of spatial signs. Concentration steps take the ``share``
of rows nearest to an estimate and estimate again; after two of them the start of least determinant
goes on until determinants no longer fall. Covariances are made consistent for normal rows, and get the
variances of ``FLOORS`` on their diagonal, as many statistics are nearly constant. Quantiles of distances come from counts of narrow
bins, so a group of any size is summed up before it is shuffled and no group meets in one task.

Groups are estimated on three levels: language and source, language, all. An estimate is drawn to that of
the level above with the weight of ``prior_rows`` rows, and that of all rows to a wide prior, so a small
group is judged mildly and there is no size at which the rule changes.

Defined cases: a null text has no words and fails the base rules; null language or source is a group
of its own; a table of few rows is judged by the wide prior for the most part; repeated rows give
repeated rows; the input's other columns are kept apart and cannot clash; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispan.llm.common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Least standard deviation of each statistic; most documents have none of the last three.
FLOORS = (0.05, 0.3, 0.05, 0.08, 0.08)
P = len(FLOORS)
#: The prior of all rows is so many times as wide as the floors.
PRIOR_WIDTH = 4.0
# Fixed values of the chi-squared distribution with P = 5 degrees of freedom: its median, the quantile that
# one row in 100,000 exceeds, and share / P(chi2 with P + 2 degrees <= the share's quantile) for a share of 0.75.
CHI2_MEDIAN, CHI2_CUT, CONSISTENCY = 4.351, 30.856, 1.4121
BINS = 100


def base_statistics(df: DataFrame, text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); row is the whole input row, or ``row``."""
    text = F.coalesce("text", F.lit(""))
    split = df.select((F.struct(*df.columns) if row is None else row).alias("row"), F.col(text_col).cast("string").alias("text")).select("row", F.regexp_count(text, F.lit(SYMBOLS)).alias("symbols"), F.array_remove(F.split(text, SPACE), "").alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    hashed = split.select("row", "symbols", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("chars"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup"))
    h = F.col("h")
    windows = F.when(F.col("n") >= 5, F.transform(F.sequence(F.lit(0), F.col("n") - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])))
    windowed = hashed.select("row", "symbols", "n", "chars", "dup", windows.alias("win"))
    repeated = F.size("win") > F.size(F.array_distinct("win"))
    # windows in order of hash, then place; only of texts in which some window recurs
    ordered = windowed.select("row", "symbols", "n", "chars", "dup", F.when(repeated, F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    s = F.col("s")
    same = lambda x, k: F.get(s, k)["h"] == x["h"]
    places = F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce((k > 0) & same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x["i"]))
    placed = ordered.select("row", "symbols", "n", "chars", "dup", places.alias("places"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate("places", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return placed.select("row", F.col("n").cast("long").alias("n_words"), F.col("chars").cast("long").alias("word_chars"), F.col("symbols").cast("long").alias("n_symbols"), F.col("dup").cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def statistic_vector() -> list[Column]:
    """Transformed statistics; ratios are drawn to usual values where a text has few words."""
    n = F.col("n_words") + 20.0
    return [F.log((F.col("word_chars") + 200.0) / (F.col("n_words") + 40.0)), F.log(F.col("n_words") + 1.0), F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 20.0)), F.sqrt(F.col("n_dup_lines") / n), F.col("n_repeat_words") / n]


def _binned_quantile(rows: DataFrame, by: list[str], bin_col: str, share: float) -> DataFrame:
    """(by, bin): the lowest bin up to which at least ``share`` of the rows lie."""
    counts = rows.groupBy(*by, bin_col).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    sums = counts.select("*", F.sum("c").over(w.orderBy(bin_col)).alias("up_to"), F.sum("c").over(w).alias("all"))
    return sums.where(F.col("up_to") >= F.col("all") * share).groupBy(*by).agg(F.min(bin_col).alias("bin"))


MEANS, COVARIANCES = [f"m_{i}" for i in range(P)], [f"c_{i}_{j}" for i in range(P) for j in range(i + 1)]
VALUES = [f"x_{i}" for i in range(P)]


def _total(terms: list[str]) -> str:
    return " + ".join(["0D", *terms])


# Matrices are written as SQL text: a column object for each of their sums and products costs the driver seconds.


def _with_inverse(stats: DataFrame) -> DataFrame:
    """Adds p_i_j, the inverse of the covariance c_i_j, and logdet, by Cholesky factors, one column after the other."""
    kept = stats.columns
    c = lambda i, j: f"c_{max(i, j)}_{min(i, j)}"
    for j in range(P):
        stats = stats.selectExpr("*", f"sqrt(greatest(1e-12D, {c(j, j)} - ({_total([f'l_{j}_{k} * l_{j}_{k}' for k in range(j)])}))) AS l_{j}_{j}")
        if j + 1 < P:
            stats = stats.selectExpr("*", *[f"({c(i, j)} - ({_total([f'l_{i}_{k} * l_{j}_{k}' for k in range(j)])})) / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, P)])
    for i in range(P):  # the inverse of the factor, row by row
        stats = stats.selectExpr("*", *[f"({float(i == j)}D - ({_total([f'l_{i}_{k} * v_{k}_{j}' for k in range(j, i)])})) / l_{i}_{i} AS v_{i}_{j}" for j in range(i + 1)])
    inverse = [f"{_total([f'v_{k}_{i} * v_{k}_{j}' for k in range(i, P)])} AS p_{i}_{j}" for i in range(P) for j in range(i + 1)]
    logdet = _total([f"2D * ln(l_{j}_{j})" for j in range(P)])
    return stats.selectExpr(*kept, *inverse, f"{logdet} AS logdet")


def _distance() -> Column:
    d = lambda i: f"(x_{i} - m_{i})"
    return F.expr(_total([f"p_{i}_{j} * {d(i)} * {d(j)} * {1 if i == j else 2}D" for i in range(P) for j in range(i + 1)]))


#: Estimates of at most so many groups (less than 2 KB each) are sent to all executors.
BROADCAST_GROUPS = 20_000
SALTS = 32


def _met(rows: DataFrame, table: DataFrame, groups: int, *more: str, how: str = "inner") -> DataFrame:
    """Rows with what ``table`` holds of their group.

    The table is broadcast if there are few groups, by a count; else rows of a group are dealt over ``SALTS``
    keys, so a group of any size is met by many tasks.
    """
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(table), ["grp", *more], how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, ["grp", "salt", *more], how).drop("salt")


def _floored(i: int, j: int, covariance: Column) -> Column:
    return covariance + FLOORS[i] ** 2 if i == j else covariance


def _starts(rows: DataFrame, scratch: Scratch, groups: int) -> DataFrame:
    """(grp, s, means, covariances) of the three starts of each group of ``rows`` (grp, values)."""
    values = rows.select("grp", F.posexplode(F.array(*VALUES)).alias("i", "x"))
    to_bin = lambda x: F.round(x * 500).cast("long")
    centre = _binned_quantile(values.select("grp", "i", to_bin(F.col("x")).alias("b")), ["grp", "i"], "b", 0.5).select("grp", "i", (F.col("bin") / 500).alias("m"))
    centre = scratch.save(centre, "centre")
    spread = _met(values, centre, groups, "i").select("grp", "i", "m", to_bin(F.abs(F.col("x") - F.col("m"))).alias("b"))
    mad = _binned_quantile(spread, ["grp", "i"], "b", 0.5).join(centre, ["grp", "i"])
    floor = F.get(F.array(*map(F.lit, FLOORS)), "i")
    width = F.sqrt(F.pow(F.col("bin") / 500 * 1.4826, 2) + floor * floor)
    columns = [F.max(F.when(F.col("i") == i, c)).alias(f"{name}_{i}") for i in range(P) for name, c in (("m", F.col("m")), ("w", width))]
    scale = scratch.save(mad.groupBy("grp").agg(*columns), "scale0")
    z = _met(rows, scale, groups).select("grp", *[((F.col(f"x_{i}") - F.col(f"m_{i}")) / F.col(f"w_{i}")).alias(f"z_{i}") for i in range(P)])
    length = F.sqrt(reduce(add, [F.col(f"z_{i}") ** 2 for i in range(P)]) + 1e-9)
    drawn = z.select("grp", *[F.tanh(f"z_{i}").alias(f"t_{i}") for i in range(P)], *[(F.col(f"z_{i}") / length).alias(f"u_{i}") for i in range(P)])
    sums = drawn.groupBy("grp").agg(*[F.avg(F.col(f"{n}_{i}") * F.col(f"{n}_{j}")).alias(f"{n}_{i}_{j}") for n in "tu" for i in range(P) for j in range(i + 1)])
    both = sums.join(scale, "grp")
    shape = lambda n, i, j: F.col(f"{n}_{i}_{j}") / F.sqrt((F.col(f"{n}_{i}_{i}") + 1e-9) * (F.col(f"{n}_{j}_{j}") + 1e-9))
    width2 = lambda i, j: F.col(f"w_{i}") * F.col(f"w_{j}")
    out = None
    for s, name in enumerate((None, "t", "u")):
        start = both.select("grp", F.lit(s).alias("s"), *MEANS, *[_floored(i, j, F.lit(float(i == j)) * width2(i, j) if name is None else shape(name, i, j) * width2(i, j)).alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)])
        out = start if out is None else out.unionByName(start)
    return out


def _concentrated(rows: DataFrame, estimate: DataFrame, scratch: Scratch, share: float, name: str, groups: int) -> DataFrame:
    """One concentration step of every estimate (grp, s, ...)."""
    near = _met(rows, estimate, groups).select("grp", "s", *VALUES, F.floor(F.log(_distance() + 1e-6) * BINS).cast("long").alias("b"))
    cut = scratch.save(_binned_quantile(near, ["grp", "s"], "b", share).withColumnRenamed("bin", "cut"), f"cut-{name}")
    core = _met(near, cut, groups, "s").where(F.col("b") <= F.col("cut"))
    means = [F.avg(f"x_{i}").alias(f"m_{i}") for i in range(P)]
    floor = lambda i, j: FLOORS[i] ** 2 if i == j else 0.0
    products = [F.expr(f"{CONSISTENCY}D * (avg(x_{i} * x_{j}) - avg(x_{i}) * avg(x_{j})) + {floor(i, j)}D").alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)]
    return scratch.save(_with_inverse(core.groupBy("grp", "s").agg(*means, *products)), f"estimate-{name}")


def covariance_determinants(rows: DataFrame, scratch: Scratch, share: float, steps: int, groups: int) -> DataFrame:
    """(grp, means, covariances, logdet): the estimate of least determinant of each group of ``rows`` (grp, values)."""
    estimate = scratch.save(_with_inverse(_starts(rows, scratch, groups)), "estimate-start")
    for k in range(2):
        estimate = _concentrated(rows, estimate, scratch, share, f"all{k}", groups)
    best = estimate.groupBy("grp").agg(F.min(F.struct("logdet", "s")).alias("best")).select("grp", "best.s")
    estimate = scratch.save(estimate.join(best, ["grp", "s"]), "estimate-best")
    for k in range(steps):
        last, estimate = estimate, _concentrated(rows, estimate, scratch, share, f"best{k}", groups)
        fell = last.select("grp", F.col("logdet").alias("before")).join(estimate, "grp").agg(F.max(F.col("before") - F.col("logdet")).alias("fell")).first()["fell"]
        if fell is None or fell < 0.01:  # bins of distances are a hundredth wide
            break
    return estimate.select("grp", *MEANS, *COVARIANCES, "logdet")


def _drawn(estimate: DataFrame, above: DataFrame, prior_rows: float) -> DataFrame:
    """Estimates (grp, n, above, ...) mixed with those of the level above, which weigh ``prior_rows`` rows."""
    both = estimate.join(above.select(F.col("grp").alias("above"), *[F.col(c).alias(f"a_{c}") for c in (*MEANS, *COVARIANCES)]), "above")
    both = both.withColumn("w", prior_rows / (F.col("n") + prior_rows))
    gap = lambda i: f"(m_{i} - a_m_{i})"
    means = [f"(1 - w) * {m} + w * a_{m} AS {m}" for m in MEANS]
    mixed = [f"(1 - w) * c_{i}_{j} + w * a_c_{i}_{j} + w * (1 - w) * {gap(i)} * {gap(j)} AS c_{i}_{j}" for i in range(P) for j in range(i + 1)]
    return both.selectExpr("grp", "n", *means, *mixed)


def robust_quality(df: DataFrame, cutoff: float = CHI2_CUT, share: float = 0.75, steps: int = 6, prior_rows: float = 60.0, min_words: int = 10, repeat_percent: int = 20, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", payload: list[str] | None = None) -> DataFrame:
    """(row, the base counts, base_failed, distance, kept) of each row.

    row is the whole input row, or its columns ``payload``; only these and counts are written to the shared folder.
    """
    scratch = Scratch(df.sparkSession, "quality")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    carried = F.struct(F.struct(*(df.columns if payload is None else payload)).alias("row"), named(lang_col).alias("lang"), named(source_col).alias("source"))
    counted = base_statistics(df, text_col, carried)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    groups = (F.lit("*").alias("all_"), F.concat(F.lit("L"), "row.lang").alias("lang_"), F.concat(F.lit("S"), "row.lang", F.lit("\t"), "row.source").alias("grp"))
    counted = counted.select("row.row", *groups, *[c for c in counted.columns if c != "row"], failed.alias("base_failed"), *[x.cast("double").alias(f"x_{i}") for i, x in enumerate(statistic_vector())])
    rows = scratch.save(counted, "rows")
    plain = rows.where(~F.col("base_failed"))
    sizes = scratch.save(plain.groupBy("all_", "lang_", "grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    groups = sizes.count()
    leveled = plain.select(F.explode(F.array("all_", "lang_", "grp")).alias("grp"), *VALUES)
    estimate = covariance_determinants(leveled, scratch, share, steps, groups)

    size_of = lambda level, above: sizes.groupBy(F.col(level).alias("grp"), F.col(above).alias("above")).agg(F.sum("n").alias("n"))
    wide = [F.col(m) for m in MEANS] + [F.lit((PRIOR_WIDTH * FLOORS[i]) ** 2 if i == j else 0.0).alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)]
    settled = estimate.where("grp = '*'").select("grp", *wide)
    for level, above in (("all_", "all_"), ("lang_", "all_"), ("grp", "lang_")):
        settled = scratch.save(_drawn(estimate.join(size_of(level, above), "grp"), settled, prior_rows), f"drawn-{level}")
    settled = scratch.save(_with_inverse(settled).drop("n", "logdet", *COVARIANCES), "settled")

    # distances of heavy-tailed groups are scaled to the usual median; few rows take that of all
    placed = _met(plain, settled, groups).select(F.explode(F.array(F.lit("*"), "grp")).alias("grp"), F.floor(F.log(_distance() + 1e-6) * BINS).cast("long").alias("b"))
    middle = scratch.save(_binned_quantile(placed, ["grp"], "b", 0.5).select("grp", F.greatest(F.lit(1.0), F.exp(F.col("bin") / BINS) / CHI2_MEDIAN).alias("scale")), "middle")
    usual = middle.where("grp = '*'").select(F.col("grp").alias("above"), F.col("scale").alias("usual"))
    scale = middle.join(size_of("grp", "all_"), "grp").join(usual, "above").select("grp", ((F.col("n") * F.col("scale") + prior_rows * F.col("usual")) / (F.col("n") + prior_rows)).alias("scale"))
    final = scratch.save(settled.join(scale, "grp"), "final")
    judged = _met(rows, final, groups, how="left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
