"""Quality rules with robust multivariate outliers.

Each language and source gets a minimum-covariance-determinant estimate of its transformed
statistics: from three deterministic starts, concentration steps refit mean and covariance
on the half of the rows with the smallest Mahalanobis distances (Rousseeuw and Van Driessen
1999), and the start with the smallest determinant wins. Rows far from it are rejected.

A step is one aggregation over all rows: distances fall into fine logarithmic bins, counts
per bin fix the half, and sums of values and products give the next estimate. Groups are
never gathered; one of any size is summed map-side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import slices
from docweave.session import store

STATS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
Z = ("z0", "z1", "z2", "z3")
P = len(Z)
#: Groups below so many rows are judged by the estimate of their language, small languages by
#: that of all rows, and in a smaller table yet the estimate rests on all rows, not on half.
LEAST_ROWS = 40
STEPS = 8
#: Logarithmic bins per factor of two of a squared distance.
BINS = 16
#: Added to variances, so that constant statistics give no singular matrix.
RIDGE = 0.05
#: Chi-square quantiles with 4 degrees of freedom: the median, and 1 - 1e-5.
MEDIAN, CUTOFF = 3.3567, 28.473
_SYMBOLS = "#*$%&|<>"


def statistics_of(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    blanks = sum(text.count(c) for c in " \t\n\v\f\r")
    seen, dups = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dups += 1
        elif line and not line.isspace():
            seen.add(line)
    repeats, n = 0, len(words)
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        pairs = ids[:-1] * len(number) + ids[1:]
        _, pairs = np.unique(pairs, return_inverse=True)
        _, at, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        hit = times[at] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= hit
        repeats = int(covered.sum())
    return n, len(text) - blanks, sum(map(text.count, _SYMBOLS)), dups, repeats


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, four statistics, base_failed), one narrow pass."""
    names = ["n_words", *STATS]

    def run(batches):
        for batch in slices(batches):
            columns = zip(*(statistics_of(t) for t in batch.column(3).to_pylist()), strict=True)
            arrays = [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "source", *names])

    ddl = "doc_id bigint, lang string, source string, " + ", ".join(f"{x} bigint" for x in names)
    chosen = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("lang", "source", "text")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return chosen.mapInArrow(run, ddl).withColumn("base_failed", failed)


def _transformed() -> list[Column]:
    """Mean word length, symbol, repeated-line and repeated-word rates on bent scales, on
    which one repeated line or sentence in a text of usual length lies near to none."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.col("word_chars") / n + 1), F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n), F.col("n_repeat_words") / n,
    ]


def _fits(sums: DataFrame) -> DataFrame:
    """Mean, inverse covariance and log determinant of each row of sums."""
    flat = ", ".join(["g string, start int, n double, mean array<double>, inverse array<double>, logdet double"])

    def run(frames):
        import pandas as pd  # in tasks only, not in the driver

        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                mean = np.array([getattr(r, f"s{i}") for i in range(P)]) / r.n
                cov = np.array([[getattr(r, f"s{min(i, j)}{max(i, j)}") for j in range(P)] for i in range(P)]) / r.n - np.outer(mean, mean)
                if r.start == 1:
                    cov = np.diag(np.diag(cov))
                cov = cov * r.scale + np.eye(P) * RIDGE**2
                rows.append((r.g, r.start, r.n, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(rows, columns=["g", "start", "n", "mean", "inverse", "logdet"])

    return sums.mapInPandas(run, flat)


def _sums(rows: DataFrame, scale: Column) -> DataFrame:
    products = [F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"s{i}{j}") for i in range(P) for j in range(i, P)]
    sums = rows.groupBy("g", "start").agg(F.count("*").cast("double").alias("n"), *(F.sum(z).alias(f"s{i}") for i, z in enumerate(Z)), *products)
    return sums.withColumn("scale", scale)


def _distance() -> Column:
    d = [F.col(z) - F.col("mean")[i] for i, z in enumerate(Z)]
    return F.greatest(F.lit(0.0), sum((d[i] * d[j] * F.col("inverse")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0)))


def _nearest(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Rows of each start's nearest half, by whole bins of their distance."""
    far = rows.join(fits.select("g", "start", "mean", "inverse"), "g")
    far = far.withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * BINS).cast("int")).drop("mean", "inverse")
    bins = far.groupBy("g", "start", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g", "start")
    upto = F.sum("n").over(w.orderBy("bin"))
    total = F.sum("n").over(w)
    half = F.when(total < LEAST_ROWS, total).otherwise(total / 2)
    last = bins.withColumn("over", upto >= half).where("over").groupBy("g", "start").agg(F.min("bin").alias("last"))
    return far.join(last, ["g", "start"]).where("bin <= last")


def reject_outliers(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """Statistics, base verdict, squared robust ``distance`` and ``kept`` of every document.

    Estimates use all rows that pass the base rules. Null languages and sources are groups
    of their own. Rows of groups below ``LEAST_ROWS`` are judged by the estimate of all rows
    of their language, or of all rows if these are too few as well. Null, empty and blank texts have no words and fail them.
    Repeated rows count each; a null ``doc_id`` stays; an empty table gives no rows.
    """
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    g = F.concat_ws("\1", lang, F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    stats = store(text_statistics(docs), "statistics")
    groups = stats.groupBy(g.alias("g"), lang.alias("lang")).agg(F.count_if(~F.col("base_failed")).alias("rows"))
    langs = groups.groupBy("lang").agg(F.sum("rows").alias("lang_rows"))
    # ``used`` is the estimate that judges a group; its rows also serve the wider ones in use.
    wider = F.when(F.col("lang_rows") >= LEAST_ROWS, F.concat(F.lit("lang"), "lang")).otherwise(F.lit("all"))
    used = F.when(F.col("rows") >= LEAST_ROWS, F.concat(F.lit("group"), "g")).otherwise(wider)
    groups = store(groups.join(langs, "lang").select("g", "lang", used.alias("used")), "groups")
    feeds = groups.select("g", F.explode(F.array(F.concat(F.lit("group"), "g"), F.concat(F.lit("lang"), "lang"), F.lit("all"))).alias("used"))
    feeds = store(feeds.join(groups.select("used").distinct(), "used", "left_semi"), "feeds")
    zs = stats.where(~F.col("base_failed")).select(g.alias("g"), *(z.alias(n) for z, n in zip(_transformed(), Z, strict=True)))
    zs = zs.join(feeds, "g").select(F.col("used").alias("g"), *Z)
    big = store(zs.groupBy("g").agg(*(F.percentile_approx(z, 0.5, 1000).alias(f"m{i}") for i, z in enumerate(Z))), "medians")
    # Starts: all rows, all rows without correlations, and the half around the medians.
    every = zs.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    around = big.select("g", F.lit(2).alias("start"), F.array(*(F.col(f"m{i}") for i in range(P))).alias("mean"), F.array(*(F.lit(float(i == j)) for i in range(P) for j in range(P))).alias("inverse"))
    first = _sums(every, F.lit(1.0)).unionByName(_sums(_nearest(zs, around), F.lit(1.0)))
    fits = store(_fits(first), "fit")
    for _ in range(steps):
        fits = store(_fits(_sums(_nearest(zs, fits), F.lit(1.0))), "fit")
    best = fits.groupBy("g").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("f")).select("g", "f.mean", "f.inverse")
    best = store(best, "fit")
    # The half has too small a spread: distances are scaled to the median of a normal sample.
    spread = zs.join(best, "g").withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * BINS).cast("int")).groupBy("g", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g")
    middle = spread.withColumn("over", F.sum("n").over(w.orderBy("bin")) >= F.sum("n").over(w) / 2).where("over").groupBy("g").agg((F.pow(F.lit(2.0), (F.min("bin") + 1) / BINS) / MEDIAN).alias("factor"))
    best = best.join(middle, "g").withColumn("factor", F.greatest("factor", F.lit(1.0)))
    best = groups.select("g", "used").join(best.withColumnRenamed("g", "used"), "used")
    judged = stats.withColumn("g", g).withColumns(dict(zip(Z, _transformed(), strict=True))).join(best, "g", "left")
    distance = F.when(F.col("mean").isNotNull(), _distance() / F.col("factor"))
    judged = judged.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return judged.select("doc_id", "lang", "source", "n_words", *STATS, "base_failed", kept.alias("kept"), "distance")
