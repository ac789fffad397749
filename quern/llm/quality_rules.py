"""Quality rules: base rules, then robust multivariate outliers.

Each document gets five counts. Documents that pass the base rules are
described by a vector of transformed statistics; for each language and source
the minimum covariance determinant gives a location and a scatter that junk
cannot pull towards itself, and a document is rejected when its Mahalanobis
distance is beyond ``cutoff``.

The estimate runs as aggregations only. A concentration step finds for each
group the distance below which the share ``SUPPORT`` of the rows lies, then
the mean and the covariance of these rows; the determinant never rises from
one step to the next. It is begun from two places (median and MAD; mean and
standard deviation) and the end with the smaller determinant counts.

A group's estimate is drawn towards that of its language, and that towards the
estimate of all documents, the more the smaller it is: with n rows its own
share is n / (n + ``PRIOR``), at any size.

Quantiles are those of Spark's percentile_approx: exact in groups of up to 1000
rows, and within a thousandth of the rows beyond, where they may depend on the
order in which partial summaries meet.

Defined results: a null text has no words and so fails the base rules; null
languages and sources are groups of their own; repeated rows are judged one by
one; texts of any length are counted whole; in an empty table nothing is
estimated; ties at a limit count as inner rows; other columns, whatever their
names, can be carried in a struct of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACE_RUN, WORD_CHAR, broadcast_if_small, let, materialize, quoted, table, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SUPPORT = 0.75
STEPS = 4
#: Rows at which a group's own estimate has half the weight.
PRIOR = 60
#: Standard deviations added to each axis, so that a statistic which is the
#: same in most documents of a group doesn't make every other value an outlier.
#: That of the length is large: a long document is not junk by that alone.
FLOOR = {"x_len": 1.0, "x_mean": 0.12, "x_symbols": 0.35, "x_dup": 0.12, "x_repeat": 0.12, "x_again": 0.12}
AXES = tuple(FLOOR)
#: The squared distance that a six-dimensional normal exceeds once in 1e6 rows.
CUTOFF = 38.3
#: Makes the scatter of the inner SUPPORT of a six-dimensional normal that of all:
#: SUPPORT / P(chi2 with 8 degrees < q), q = 7.841 the SUPPORT quantile of chi2 with 6.
CONSISTENCY = 1.362


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that the same list holds twice or more."""
    starts = F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, window)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            at = F.array_sort(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")), lambda a: a["n"])

        return let(pairs, of_sorted)

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return let(hashes, counted)


def base_counts(text: Column) -> Column:
    """A struct of the counts of a text; ``n_again``: words equal to the one before."""
    t = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR))
        dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.regexp_replace(t, SPACE_RUN, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long").alias("n_again"),
        )

    return let(words_of(text), of_words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_again")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def statistic_vector() -> list[Column]:
    """Transformed statistics, each about symmetric among ordinary documents."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n).alias("x_len"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("x_mean"),
        F.log1p(20 * F.col("n_symbols") / n).alias("x_symbols"),
        F.sqrt(F.col("n_dup_lines") / n).alias("x_dup"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x_repeat"),
        F.sqrt(F.col("n_again") / n).alias("x_again"),
    ]


def _factor(groups: DataFrame) -> DataFrame:
    """Columns m_i and c_i_j, with the factor l_i_j and log_det.

    The factor's columns are added row by row of the matrix, so that each
    expression stays short.
    """
    d = len(AXES)
    out = groups
    for i in range(d):
        for j in range(i + 1):
            s = F.col(f"c_{i}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l_{j}_{j}"))
    det = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, d)), F.log(F.col("l_0_0")))
    return out.withColumn("log_det", 2 * det)


def _shrunk(groups: DataFrame, prior: int) -> DataFrame:
    """fine (a group), m_i and l_i_j: each estimate drawn towards its language's, and that towards that of all."""
    d = len(AXES)
    names = [f"m_{i}" for i in range(d)] + [f"c_{i}_{j}" for i in range(d) for j in range(i + 1)]
    own, lang = (groups.where(F.col("level") == k).select(F.col("grp").alias(f"g{k}"), F.col("lang").alias(f"lang{k}"), F.struct("n", *names).alias(f"e{k}")) for k in (0, 1))
    every = groups.where("level = 2").first()  # one row
    both = own.join(broadcast_if_small(lang), F.col("lang0").eqNullSafe(F.col("lang1")))

    def drawn(k: int, name: str, towards: Column) -> Column:
        n = F.col(f"e{k}.n")
        return (n * F.col(f"e{k}.{name}") + prior * towards) / (n + prior)

    return _factor(both.select(F.col("g0").alias("fine"), *[drawn(0, c, drawn(1, c, F.lit(every[c] if every else 0.0))).alias(c) for c in names]))


def squared_distance() -> Column:
    """The Mahalanobis distance from m_i under the factor l_i_j, by forward substitution."""

    def step(i: int, solved: list[Column]) -> Column:
        if i == len(AXES):
            return sum((z * z for z in solved[1:]), solved[0] * solved[0])
        s = F.col(AXES[i]) - F.col(f"m_{i}")
        for k, z in enumerate(solved):
            s = s - F.col(f"l_{i}_{k}") * z
        return let(s / F.col(f"l_{i}_{i}"), lambda z: step(i + 1, [*solved, z]))

    return step(0, [])


def _floor(i: int, j: int) -> float:
    return FLOOR[AXES[i]] ** 2 if i == j else 0.0


def _starts(vectors: DataFrame) -> DataFrame:
    """Two diagonal estimates of each group."""
    d = len(AXES)
    med = vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(a, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, a in enumerate(AXES)], *[F.avg(a).alias(f"a_{i}") for i, a in enumerate(AXES)], *[F.stddev_pop(a).alias(f"s_{i}") for i, a in enumerate(AXES)])

    def begin(start: int) -> DataFrame:
        mean = [(F.get(f"q_{i}", F.lit(1)) if start == 0 else F.col(f"a_{i}")).alias(f"m_{i}") for i in range(d)]
        spread = [(F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / 1.349 if start == 0 else F.col(f"s_{i}") for i in range(d)]
        cov = [((spread[i] * spread[i] + _floor(i, i)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)]
        return med.select("grp", F.lit(start).alias("start"), "n", *mean, *cov)

    return _factor(begin(0).unionByName(begin(1)))


def _concentrate(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """One concentration step for every group and start."""
    d = len(AXES)
    measured = vectors.join(broadcast_if_small(groups), "grp").select("grp", "start", *AXES, squared_distance().alias("d2"))
    limit = materialize(measured.groupBy("grp", "start").agg(F.percentile_approx("d2", F.lit(SUPPORT), F.lit(2000)).alias("limit"), F.count(F.lit(1)).alias("n")), "mcd-limit")
    inner = measured.join(broadcast_if_small(limit), ["grp", "start"]).where(F.col("d2") <= F.col("limit"))
    mean = [F.avg(a).alias(f"m_{i}") for i, a in enumerate(AXES)]
    cov = [(F.covar_pop(AXES[i], AXES[j]) * CONSISTENCY + _floor(i, j)).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)]
    found = inner.groupBy("grp", "start").agg(F.max("n").alias("n"), *mean, *cov)
    return materialize(_factor(found), "mcd-step")


def robust_estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """The estimate of each group ``grp`` of vectors: m_i, c_i_j, l_i_j and n."""
    groups = materialize(_starts(vectors), "mcd-start")
    for _ in range(steps):
        groups = _concentrate(vectors, groups)
    best = groups.groupBy("grp").agg(F.min_by(F.struct(*[c for c in groups.columns if c != "grp"]), F.struct("log_det", "start")).alias("best"))
    return materialize(best.select("grp", "best.*").drop("start", "log_det"), "mcd")


def assess(docs: DataFrame, carry=(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, prior: int = PRIOR, steps: int = STEPS) -> DataFrame:
    """Counts and verdict of each document, and the columns named in ``carry``.

    Returns the carried columns as a struct ``carried`` where there are any,
    doc_id, the counts, base_failed, distance2 (null where the base rules
    failed) and kept. The counts are written once to the shared folder, so that
    no text is read again.
    """
    held = [F.struct(*[F.col(quoted(c)).alias(c) for c in carry]).alias("carried")] if carry else []
    counted = docs.select(*held, F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(lang)).alias("lang"), F.col(quoted(source)).alias("source"), base_counts(F.col(quoted(text))).alias("c"))
    counted = materialize(counted.select(*["carried"] * bool(carry), "doc_id", "lang", "source", *[F.col(f"c.{c}").alias(c) for c in COUNTS]), "counts")
    counted = counted.withColumn("base_failed", base_failed())
    passed = counted.where(~F.col("base_failed")).select("lang", "source", *statistic_vector())
    # Each vector counts in its group, its language and among all.
    none = F.lit(None).cast("string")
    groups = [F.struct(F.lit(k).alias("level"), lang_.cast("string").alias("lang"), source_.cast("string").alias("source")) for k, (lang_, source_) in enumerate(((F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)))]
    vectors = materialize(passed.select(F.explode(F.array(*[F.to_json(g) for g in groups])).alias("grp"), *AXES), "vectors")
    found = robust_estimates(vectors, steps)
    key = F.from_json("grp", "level int, lang string, source string")
    found = materialize(found.select("*", key["level"].alias("level"), key["lang"].alias("lang")), "groups")
    side = materialize(_shrunk(found, prior).select("fine", F.struct(*[f"m_{i}" for i in range(len(AXES))], *[f"l_{i}_{j}" for i in range(len(AXES)) for j in range(i + 1)]).alias("estimate")), "estimates")
    judged = counted.join(broadcast_if_small(side), F.to_json(groups[0]) == F.col("fine"), "left")
    judged = judged.select(*["carried"] * bool(carry), "doc_id", *COUNTS, "base_failed", *statistic_vector(), "estimate.*")
    judged = judged.withColumn("distance2", F.when(~F.col("base_failed"), squared_distance()))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance2") <= cutoff, F.lit(True)))
    return judged.select(*["carried"] * bool(carry), "doc_id", *COUNTS, "base_failed", "distance2", kept.alias("kept"))


def keep_clean(docs: DataFrame, **params) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    judged = assess(docs, carry=docs.columns, **params)
    return judged.where("kept").select("carried.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, judged within its language and source."""
    return assess(table(spark, sf_dir, "documents")).drop("distance2")
