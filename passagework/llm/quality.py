"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Only DataFrame functions are used: texts never leave the JVM.

1. ``profile`` takes each whole text to its word statistics.
2. ``keyed`` judges a document by its (lang, source), or by its lang, or by the
   corpus, whichever is the finest level with at least ``min_group`` documents that
   enter its estimate.  The estimate of a lang or of the corpus is made of all its
   documents, also of those that are judged by a finer level.
3. ``mcd`` runs concentration steps per group from two starts, as parallel keys of the
   same aggregations: the mean and covariance of all rows, and the medians with
   the median absolute deviations, which rows that are less than half cannot move.
   The ``coverage`` share of rows with the smallest Mahalanobis distance gives the next mean
   and covariance.  A start keeps its least determinant; steps end when no start of
   any group gets lower, and a group takes the start with the least.  The h-th smallest
   distance and the medians come from histograms (a bounded number of bins a group),
   so that no group is ever gathered or sorted in one task.
4. A document is rejected when its distance exceeds the chi-square cutoff.

Copies of an outlying text that make up less than 1 - ``coverage`` of a group do not enter its
estimate.

The covariance is regularised by a fixed diagonal (``FLOORS`` squared), since in
most groups more than ``coverage`` of the documents have no symbol and no
repeated line at all, and a plain determinant would be zero there.

Defined cases: a null or empty text has no words, fails the base rules and takes
no part in the estimates; null lang or source is a value like any other; groups
below ``MIN_ESTIMATE`` rows even at corpus level give no verdict of their own (the document
is kept); repeated rows each get their own row; extra columns pass through
``quality_rules`` untouched (the operator's own columns carry the prefix ``_q_``
until the end, and replace columns of the same name).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, settle, text_or_empty

#: Statistics of the vector and the least spread each is credited with.
FLOORS = {"v_length": 0.06, "v_symbols": 0.8, "v_lines": 0.12, "v_repeats": 0.12}
VECTOR = tuple(FLOORS)
COVERAGE = 0.6
TAIL = 1e-5
MIN_GROUP = 200
MIN_ESTIMATE = 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Fall of a log determinant below which a start is settled.
SETTLED = 1e-3
#: Bins of the distance histogram per doubling of the distance.
BINS = 64
#: Fixed-point unit of the vector: sums are exact, so that results do not depend on the order of rows.
UNIT = 1 << 16
#: Width of the bins of the medians, in units; and what makes a median absolute deviation a standard deviation of normal rows.
MIDDLE, NORMAL = UNIT // 256, 1.4826


def chi_square_cdf(x: float, p: int) -> float:
    """Regularised lower incomplete gamma function P(p/2, x/2), by its power series."""
    if x <= 0:
        return 0.0
    a, y = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= y / k
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, p) < q else (low, middle)
    return (low + high) / 2


def consistency(coverage: float, p: int) -> float:
    """Factor that makes the covariance of the nearest ``coverage`` of normal rows unbiased."""
    return coverage / chi_square_cdf(chi_square_quantile(coverage, p), p + 2)


def profile(docs: DataFrame) -> DataFrame:
    """Add ``_q_words`` and the other statistics of each whole text."""
    t = text_or_empty()
    trimmed = F.btrim(t, F.lit(SPACE_CHARS))
    df = docs.withColumns(
        {
            "_q_list": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+")),
            "_q_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_q_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_q_list") - 3),
        lambda i: F.xxhash64(F.get("_q_list", i), F.get("_q_list", i + 1), F.get("_q_list", i + 2)),
    )
    df = df.withColumns(
        {
            "_q_words": F.size("_q_list").cast("long"),
            "_q_chars": F.char_length(F.array_join("_q_list", "")).cast("long"),
            "_q_n_lines": F.size("_q_lines").cast("long"),
            "_q_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_windows": F.when(F.size("_q_list") < 3, F.array().cast("array<bigint>")).otherwise(windows),
        }
    ).drop("_q_list", "_q_lines")
    repeated = F.size("_q_windows") > F.size(F.array_distinct("_q_windows"))
    df = df.withColumn(
        "_q_sorted",
        F.when(repeated, F.array_sort(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_q_windows")

    def hash_at(i: Column) -> Column:
        return F.get("_q_sorted", i)["h"]

    twice = F.filter(
        F.sequence(F.lit(0), F.size("_q_sorted") - 1),
        lambda i: F.coalesce(hash_at(i) == hash_at(i - 1), F.lit(False)) | F.coalesce(hash_at(i) == hash_at(i + 1), F.lit(False)),
    )
    df = df.withColumn("_q_starts", F.when(F.col("_q_sorted").isNotNull(), F.array_sort(F.transform(twice, lambda i: F.get("_q_sorted", i)["i"])))).drop("_q_sorted")
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("_q_starts")),
        F.lit(0).cast("long"),
        lambda total, i: total + F.coalesce(F.least(F.get("_q_starts", i) - F.get("_q_starts", i - 1), F.lit(3)), F.lit(3)).cast("long"),
    )
    return df.withColumn("_q_repeats", F.when(F.col("_q_starts").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("_q_starts")


def base_failed() -> Column:
    return (F.col("_q_words") < MIN_WORDS) | (100 * F.col("_q_repeats") > MAX_REPEAT_PERCENT * F.col("_q_words"))


def vectors(df: DataFrame) -> DataFrame:
    """Transformed statistics in units of 1/UNIT; null where a text has no word."""
    words, chars = F.col("_q_words").cast("double"), F.col("_q_chars").cast("double")
    raw = {
        "v_length": F.log(chars / words),
        "v_symbols": F.log1p(1000 * F.col("_q_symbols") / chars),
        "v_lines": F.col("_q_dup_lines") / F.col("_q_n_lines"),
        "v_repeats": F.col("_q_repeats") / words,
    }
    return df.withColumns({k: F.when(F.col("_q_words") > 0, F.round(v * UNIT).cast("long")) for k, v in raw.items()})


def keyed(df: DataFrame, lang: str, source: str, min_group: int) -> DataFrame:
    """Add ``_q_key``, the finest level with at least ``min_group`` rows that enter an estimate, and ``_q_keys``, the estimates that the row enters.

    ``df`` has ``_q_failed``.  A row enters the estimate of its (lang, source) if that is large
    enough, and those of its language and of the corpus wherever any group falls back on them.
    """

    def part(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.char_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")))

    df = df.withColumns({"_q_lang": part(lang), "_q_fine": F.concat(part(lang), part(source))})
    fine = df.groupBy("_q_lang", "_q_fine").agg(F.count(F.when(~F.col("_q_failed"), F.col("v_length"))).alias("n"))
    coarse = fine.groupBy("_q_lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    of_lang, of_fine = F.concat(F.lit("1"), F.col("_q_lang")), F.concat(F.lit("2"), F.col("_q_fine"))
    # a language under min_group has only groups under it, which all fall back on the corpus
    corpus = coarse.agg(F.coalesce(F.min("n_lang") < min_group, F.lit(False)).alias("_q_corpus"))
    level = (
        fine.join(coarse, "_q_lang")
        .crossJoin(F.broadcast(corpus))
        .select(
            "_q_fine",
            F.when(F.col("n") >= min_group, of_fine).when(F.col("n_lang") >= min_group, of_lang).otherwise(F.lit("0")).alias("_q_key"),
            F.array_compact(
                F.array(
                    F.when(F.col("n") >= min_group, of_fine),
                    F.when((F.col("n_lang") >= min_group) & (F.col("least") < min_group), of_lang),
                    F.when(F.col("_q_corpus"), F.lit("0")),
                )
            ).alias("_q_keys"),
        )
    )
    level = settle(level, "quality-groups")
    return df.join(level, "_q_fine").drop("_q_lang", "_q_fine")


def moments(df: DataFrame, *key: str) -> DataFrame:
    """Count, sums and sums of products per group; exact, whatever the order."""
    sums = [F.sum(F.col(a).cast("decimal(20,0)")).alias(f"s_{i}") for i, a in enumerate(VECTOR)]
    products = [
        F.sum((F.col(VECTOR[i]) * F.col(VECTOR[j])).cast("decimal(25,0)")).alias(f"s_{i}_{j}")
        for i in range(len(VECTOR))
        for j in range(i + 1)
    ]
    return df.groupBy(*key).agg(F.count("v_length").alias("m_n"), *sums, *products)


def estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Mean and Cholesky factor of the regularised covariance, unrolled into columns."""
    p = len(VECTOR)
    n = F.col("m_n").cast("double")
    df = sums.where(F.col("m_n") > 0).withColumns({f"mu_{i}": F.col(f"s_{i}").cast("double") / n / UNIT for i in range(p)})
    df = df.withColumns(
        {
            f"c_{i}_{j}": factor * (F.col(f"s_{i}_{j}").cast("double") / n / UNIT / UNIT - F.col(f"mu_{i}") * F.col(f"mu_{j}"))
            + (FLOORS[VECTOR[i]] ** 2 if i == j else 0.0)
            for i in range(p)
            for j in range(i + 1)
        }
    )
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[VECTOR[i]] ** 2 * 1e-6))) if i == j else rest / F.col(f"l_{j}_{j}"))
    log_det = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, p)), F.log(F.col("l_0_0"))) * 2
    keep = [f"mu_{i}" for i in range(p)] + [f"l_{i}_{j}" for i in range(p) for j in range(i + 1)]
    return df.select("_q_key", "m_n", log_det.alias("log_det"), *keep)


def distance(df: DataFrame) -> DataFrame:
    """Add ``_q_d2``, the squared Mahalanobis distance, by forward substitution."""
    p = len(VECTOR)
    for i in range(p):
        rest = F.col(VECTOR[i]) / UNIT - F.col(f"mu_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        df = df.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    return df.withColumn("_q_d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, p)), F.col("z_0") * F.col("z_0")))


def distance_bin() -> Column:
    """Index of the histogram bin: log2(d2 + 1) in steps of 1/BINS, at most BINS * 64 bins."""
    return F.least(F.floor(F.log2(F.col("_q_d2") + 1) * BINS), F.lit(BINS * 64)).cast("int")


def middles(rows: DataFrame, values: list[Column]) -> DataFrame:
    """``m_0``, ``m_1`` ...: the median of each value (in units) per ``_q_key``, to the middle of its bin."""
    from pyspark.sql import Window

    bins = F.array(*(F.struct(F.lit(i).alias("i"), F.floor(v / MIDDLE).alias("bin")) for i, v in enumerate(values)))
    counts = rows.select("_q_key", F.explode(bins).alias("b")).groupBy("_q_key", F.col("b.i").alias("i"), F.col("b.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("_q_key", "i")
    ranked = counts.withColumns({"upto": F.sum("n").over(whole.orderBy("bin")), "all": F.sum("n").over(whole)})
    middle = ranked.where(F.col("upto") * 2 >= F.col("all")).groupBy("_q_key", "i").agg(((F.min("bin") + 0.5) * MIDDLE).alias("m"))
    return middle.groupBy("_q_key").agg(*(F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m_{i}") for i in range(len(values))))


def starts(rows: DataFrame) -> DataFrame:
    """First estimates per ``_q_key``, which begins with c for mean and covariance, r for medians and deviations."""
    p = len(VECTOR)
    classical = settle(estimates(moments(rows, "_q_key"), 1.0), "quality-step")
    centre = settle(middles(rows, [F.col(v) for v in VECTOR]), "quality-centre")
    spread = middles(rows.join(centre, "_q_key"), [F.abs(F.col(v) - F.col(f"m_{i}")) for i, v in enumerate(VECTOR)])
    robust = centre.join(spread.withColumnsRenamed({f"m_{i}": f"d_{i}" for i in range(p)}), "_q_key").join(classical.select("_q_key", "m_n"), "_q_key")
    width = {i: F.sqrt((NORMAL * F.col(f"d_{i}") / UNIT) ** 2 + FLOORS[v] ** 2) for i, v in enumerate(VECTOR)}
    robust = robust.select(
        F.concat(F.lit("r"), "_q_key").alias("_q_key"),
        "m_n",
        # no row set has this determinant: the first step's is the first to count
        F.lit(float("inf")).alias("log_det"),
        *((F.col(f"m_{i}") / UNIT).alias(f"mu_{i}") for i in range(p)),
        *((width[i] if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(p) for j in range(i + 1)),
    )
    return classical.withColumns({"_q_key": F.concat(F.lit("c"), "_q_key"), "log_det": F.lit(float("inf"))}).unionByName(robust)


def step(rows: DataFrame, now: DataFrame, coverage: float) -> DataFrame:
    """The estimates that the nearest ``coverage`` of each key's rows give, and ``_q_before``, the log determinant of ``now``.

    One pass: moments are summed for each bin of the distance, and a key adds up its bins up to the limit.
    """
    from pyspark.sql import Window

    placed = distance(rows.join(now.drop("m_n"), "_q_key")).withColumn("_q_bin", distance_bin())
    binned = moments(placed, "_q_key", "_q_bin")
    whole = Window.partitionBy("_q_key")
    # a bin is inside unless those before it are enough
    ranked = binned.withColumns({"upto": F.sum("m_n").over(whole.orderBy("_q_bin")), "all": F.sum("m_n").over(whole)})
    inside = ranked.where(F.col("upto") - F.col("m_n") < F.ceil(F.col("all") * coverage))
    sums = inside.groupBy("_q_key").agg(*(F.sum(c).alias(c) for c in binned.columns if c not in ("_q_key", "_q_bin")))
    found = estimates(sums, consistency(coverage, len(VECTOR)))
    return found.join(now.select("_q_key", F.col("log_det").alias("_q_before")), "_q_key")


def mcd(rows: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Estimates per ``_q_key`` after concentration; ``rows`` holds the key and the vector."""
    rows = rows.where(F.col("v_length").isNotNull())
    now = settle(starts(rows), "quality-step")
    rows = rows.withColumn("_q_key", F.explode(F.array(*(F.concat(F.lit(x), "_q_key") for x in "cr"))))
    best = None
    while True:
        # settled starts take no further step
        found = settle(step(rows, now, coverage), "quality-step")
        lower = found.where(F.col("log_det") < F.col("_q_before")).drop("_q_before")
        best = lower if best is None else settle(best.join(lower.select("_q_key"), "_q_key", "left_anti").unionByName(lower), "quality-best")
        now = found.where(F.col("log_det") < F.col("_q_before") - SETTLED).drop("_q_before")
        if now.isEmpty():
            break
    group = F.substring("_q_key", 2, 1 << 20)
    least = best.groupBy(group.alias("_q_group")).agg(F.min(F.struct("log_det", "_q_key"))["_q_key"].alias("_q_key"))
    return best.join(least, "_q_key").drop("_q_key").withColumnRenamed("_q_group", "_q_key")


def quality_rules(docs: DataFrame, lang: str = "lang", source: str = "source", coverage: float = COVERAGE, tail: float = TAIL, min_group: int = MIN_GROUP, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) with ``n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed distance kept``.

    Texts are profiled once; the profile is written to the shared folder, and all
    further steps read its narrow columns.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
    columns = [c for c in (docs.columns if carry is None else carry) if c not in made]
    kept = [f"_q_col{i}" for i in range(len(columns))]
    renamed = docs.select(*(F.col(c).alias(k) for c, k in zip(columns, kept)), F.col("text"), F.col(lang).alias("_q_a"), F.col(source).alias("_q_b"))
    rows = settle(vectors(profile(renamed)).drop("text"), "quality-profile")
    part = rows.select("_q_a", "_q_b", base_failed().alias("_q_failed"), *VECTOR)
    part = settle(keyed(part, "_q_a", "_q_b", min_group), "quality-vectors")
    found = mcd(part.where(~F.col("_q_failed")).select(F.explode("_q_keys").alias("_q_key"), *VECTOR), coverage)
    groups = settle(part.select("_q_a", "_q_b", "_q_key").distinct().join(found, "_q_key", "left").withColumnsRenamed({"_q_a": "_q_lang", "_q_b": "_q_source"}), "quality-estimates")
    joined = rows.join(groups, F.col("_q_a").eqNullSafe(F.col("_q_lang")) & F.col("_q_b").eqNullSafe(F.col("_q_source")), "left")
    outlier = F.coalesce((F.col("m_n") >= MIN_ESTIMATE) & (F.col("_q_d2") > chi_square_quantile(1 - tail, len(VECTOR))), F.lit(False))
    return distance(joined).select(
        *(F.col(k).alias(c) for c, k in zip(columns, kept)),
        F.col("_q_words").alias("n_words"),
        F.col("_q_chars").alias("word_chars"),
        F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"),
        F.col("_q_repeats").alias("n_repeat_words"),
        base_failed().alias("base_failed"),
        F.col("_q_d2").alias("distance"),
        (~base_failed() & ~outlier).alias("kept"),
    )
