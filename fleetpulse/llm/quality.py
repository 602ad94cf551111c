"""Quality rules: robust multivariate outliers by minimum covariance determinant, natively.

Every document gets word statistics; documents that break a base rule are rejected. The rest
are points of four transformed statistics. For each language and source the minimum covariance
determinant is estimated by concentration steps: from medians and quartiles, keep the share
``support`` of the points nearest in Mahalanobis distance, take their mean and covariance, and
repeat. A point whose squared robust distance, scaled to a normal group, is beyond ``limit`` is
rejected: by default the quantile of a chi-squared variable that one normal point in ten thousand exceeds.

All steps are column expressions and map-side combined aggregates: a hot source is one row per
task in every shuffle. Only the narrow statistics are kept between steps.

Defined cases: a null or empty text has no words and fails the base rules. A null language or
source is a group of its own. A group with fewer than ``least`` passing documents is judged by the
estimate of all passing documents of its language, and where those are fewer too by that of all
languages, whatever their number. Equal rows of a group get equal verdicts; points that are all equal
are not rejected by their own estimate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACES, fresh, stored, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Spreads below these count as noise: of log word length, and of three square roots of shares.
FLOORS = (0.06, 0.06, 0.10, 0.10)
DIM = len(FLOORS)
#: Median of a chi-squared variable of four degrees of freedom.
CHI2_MEDIAN = 3.3567


def chi2_quantile(p: float) -> float:
    """Quantile of a chi-squared variable of four degrees of freedom, by bisection of its closed form."""
    low, high = 0.0, 4000.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (low, x) if math.exp(-x / 2) * (1 + x / 2) < 1 - p else (x, high)
    return high


#: 23.51
LIMIT = chi2_quantile(0.9999)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, lines, heads, marks, starts = fresh(docs, "w__", "lines__", "heads__", "marks__", "starts__")
    short = F.size(w) < WINDOW
    none = F.array().cast("array<bigint>")
    df = docs.withColumns({w: words(F.col("text")), lines: F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    df = df.withColumn(heads, F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn(heads, F.when(short, none).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(heads) - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(heads, i, WINDOW)))))
    # only texts with a repeated window pay for ordering them
    df = df.withColumn(marks, F.when(F.size(F.array_distinct(heads)) < F.size(heads), F.array_sort(
        F.transform(heads, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get(F.col(marks), k)["h"]
    df = df.withColumn(starts, F.array_sort(F.transform(
        F.filter(marks, lambda m, k: F.coalesce(at(k - 1) == m["h"], F.lit(False)) | F.coalesce(at(k + 1) == m["h"], F.lit(False))), lambda m: m["i"])))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")))["n"]
    return df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop(w, lines, heads, marks, starts)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _point() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [F.log(F.col("word_chars") / F.col("n_words")), share("n_symbols", "word_chars"),
            share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def _cholesky(cov) -> dict[str, Column]:
    """Lower factor of a covariance given as ``cov(i, j)``, with the noise floor on its diagonal."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(DIM):
        for j in range(i + 1):
            rest = cov(i, j) + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / low[j, j]
    return {f"l{i}{j}": v for (i, j), v in low.items()}


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i in range(DIM):
        rest = F.col(f"x{i}") - F.col(f"c{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * solved[k]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def group_shapes(points: DataFrame, support: float, steps: int) -> DataFrame:
    """Centre, factor, scale and size of each group ``g`` of points x0..x3."""
    quartiles = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIM)]
    start = points.groupBy("g").agg(F.count("*").alias("n"), *quartiles)
    spread = lambda i, j: F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2)) if i == j else F.lit(0.0)
    shape = start.select("g", "n", *[F.col(f"q{i}")[1].alias(f"c{i}") for i in range(DIM)],
                         *[c.alias(k) for k, c in _cholesky(spread).items()])
    shape = stored(shape, "quality-shape")
    pairs = [(i, j) for i in range(DIM) for j in range(i + 1)]
    for _ in range(steps):
        at = points.join(shape, "g").withColumn("d", _distance())
        cut = at.groupBy("g").agg(F.percentile_approx("d", support, 1000).alias("cut"))
        near = points.join(shape.join(cut, "g"), "g").withColumn("d", _distance()).where("d <= cut")
        moments = near.groupBy("g").agg(
            F.max("n").alias("n"), *[F.avg(f"x{i}").alias(f"c{i}") for i in range(DIM)],
            *[F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}{j}") for i, j in pairs])
        shape = stored(moments.select("g", "n", *[f"c{i}" for i in range(DIM)],
                                      *[c.alias(k) for k, c in _cholesky(lambda i, j: F.col(f"v{i}{j}")).items()]), "quality-shape")
    middle = points.join(shape, "g").withColumn("d", _distance()).groupBy("g").agg(F.percentile_approx("d", 0.5, 1000).alias("middle"))
    # a kept half is narrower than the whole: bring the median distance to that of a normal group
    return stored(shape.join(middle, "g").withColumn("scale", F.greatest(F.col("middle") / CHI2_MEDIAN, F.lit(1.0))).drop("middle"), "quality-shape")


def judging_shapes(points: DataFrame, support: float, steps: int, least: int) -> DataFrame:
    """The shape by which each group ``g`` of points is judged: its own if it has ``least`` points, else
    that of its language ``h`` if that has, else that of all points."""
    own = group_shapes(points.drop("h"), support, steps)
    few = own.where(F.col("n") < least).select("g")
    if few.isEmpty():
        return own
    few = stored(few.join(points.select("g", "h").distinct(), "g"), "quality-few")
    spoken = points.join(few.select("h").distinct(), "h", "left_semi").withColumn("g", F.col("h")).drop("h")
    languages = group_shapes(spoken, support, steps).where(F.col("n") >= least).withColumnRenamed("g", "h")
    out = own.where(F.col("n") >= least).unionByName(few.join(languages, "h").drop("h"))
    rest = few.join(languages, "h", "left_anti").select("g")
    if rest.isEmpty():
        return out
    whole = group_shapes(points.withColumn("g", F.lit("")).drop("h"), support, steps).drop("g")
    return out.unionByName(rest.crossJoin(whole))


def quality_rules(docs: DataFrame, carry: list[str] | None = None, support: float = 0.75, steps: int = 3,
                  limit: float = LIMIT, least: int = 50) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default all) with statistics, ``base_failed`` and ``kept``.

    Carried columns that clash with a result column are dropped.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    out = [c for c in (carry if carry is not None else docs.columns)
           if c.lower() not in {*made, "base_failed", "kept", "distance", "g", "h", *(f"x{i}" for i in range(DIM))}]
    narrow = docs.select(*out, *[c for c in ("text", "lang", "source") if c not in out])
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    facts = stored(
        text_statistics(narrow).withColumn("base_failed", base_failed())
        .withColumns({"g": F.concat_ws("\u0001", known("lang"), known("source")), "h": known("lang")})
        .withColumns({f"x{i}": F.when(~F.col("base_failed"), x) for i, x in enumerate(_point())})
        .select(*out, *made, "base_failed", "g", "h", *[f"x{i}" for i in range(DIM)]), "quality-facts")
    points = facts.where(~F.col("base_failed")).select("g", "h", *[f"x{i}" for i in range(DIM)])
    shapes = judging_shapes(points, support, steps, least)
    judged = facts.join(shapes, "g", "left").withColumn("distance", _distance() / F.col("scale"))
    odd = F.col("distance") > limit
    return judged.select(*out, *made, "base_failed", "distance",
                         (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows that the quality rules reject. Verdicts are joined by two hashes of all
    that they depend on, so equal rows share theirs; no text is stored. The rejected keys are hashed in each
    partition and the rows stream past them: no text is sorted."""
    keys = {"row__": F.xxhash64("doc_id", "text", "lang", "source"), "text__": F.xxhash64("text")}
    verdicts = quality_rules(docs.select("doc_id", "text", "lang", "source", *[c.alias(k) for k, c in keys.items()]), carry=list(keys), **parameters)
    gone = verdicts.where("not kept").select(*keys).distinct().hint("shuffle_hash")
    return docs.withColumns(keys).join(gone, list(keys), "left_anti").select(*docs.columns)
