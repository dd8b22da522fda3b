"""Quality rules: hard rules, then robust multivariate outliers.

Per language and source, the minimum covariance determinant is estimated by concentration
steps: keep the nearest ``support`` share of rows, take their mean and covariance, measure
again, until no determinant falls any more. Steps start from the medians with two scales, one unit and
one from the quartiles; of the two ends the one of lesser determinant counts. Rows far away by Mahalanobis
distance are rejected. Statistics are transformed first, so that clean texts lie close to a normal cloud.

A group of n rows says n / (n + ``prior``) of its own estimate, its language the rest, and likewise the
language and a stated wide ``PRIOR`` of what texts look like. The spread between the two means adds to
the covariance by w * w * (1 - w), w being the group's weight: a group of several rows that agree is evidence
of a way of writing, one or two rows are not. So small groups lean on what is known around them, large
ones on themselves, and nothing jumps at any size.

Everything is column arithmetic: moments are sums, the Cholesky factor is unrolled over the
four statistics, quantiles come from mergeable summaries.

Edge cases. A null text has no words and fails the hard rules. Null languages and sources
are groups of their own. Texts of another language never judge a text. A ridge keeps constant
statistics from making the covariance singular. d2 is null only where a group has no row that passes
the hard rules. Rows that repeat in id and text are judged alike. Empty tables give empty results; other
columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverwell.llm.common import join_small, let, row_key, small, staged, words

#: The transformed statistics, in the order of the covariance.
DIMS = ("x0", "x1", "x2", "x3")
P = len(DIMS)
#: Least standard deviation of each: what lies within a few of these is never an outlier.
RIDGE = (0.1, 0.1, 0.15, 0.1)
#: Mean and standard deviation of each in texts of whatever language: words of 5.5 letters, give or take a factor of e (scripts
#: without spaces lie within a few of these), hardly a symbol, few repeats.
PRIOR = ((1.7, 1.0), (0.1, 0.25), (0.15, 0.25), (0.15, 0.25))


def _repeated(ws: Column, n: int = 5) -> Column:
    """Words inside ``n``-word windows that occur twice or more in ``ws``."""

    def covered(grams: Column) -> Column:
        def count(sorted_: Column) -> Column:
            size = F.size(sorted_)
            same = lambda i, j: F.get(sorted_, i)["g"] == F.get(sorted_, j)["g"]
            twice = F.filter(
                F.sequence(F.lit(0), size - 1),
                lambda i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))) | F.coalesce(same(i, i + 1), F.lit(False)),
            )
            return let(
                F.sort_array(F.transform(twice, lambda i: F.get(sorted_, i)["at"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, F.lit(n)), F.lit(n))),
                    F.lit(0),
                    lambda a, b: a + b,
                ),
            )

        pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("at")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(F.sort_array(pairs), count))

    def of(hashes: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - (n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, n)))
        return F.when(F.size(hashes) < n, F.lit(0)).otherwise(let(grams, covered))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, lang, source) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(F.col("text")), lambda ws: F.struct(F.size(ws).alias("n"), _repeated(ws).alias("r")))
    by_lines = let(full, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("d")))
    return (
        row_key(docs)
        .select(
            "doc_id", "_th", "lang", "source", by_words.alias("w"), by_lines.alias("l"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        )
        .select(
            "doc_id", "_th", "lang", "source", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
            F.col("l.d").cast("long").alias("n_dup_lines"), F.col("w.r").cast("long").alias("n_repeat_words"),
            F.col("l.n").cast("long").alias("n_lines"),
        )
    )


def hard_rules(stats: DataFrame, least_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    return stats.withColumn(
        "base_failed",
        (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")),
    )


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics: word length, symbols a word, repeated lines, repeated words."""
    per = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        stats.withColumn("x0", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / per))
        .withColumn("x1", F.sqrt(F.col("n_symbols") / per))
        .withColumn("x2", F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")))
        .withColumn("x3", F.sqrt(F.col("n_repeat_words") / per))
    )


def _factor(mean: list[Column], cov: dict[tuple[int, int], Column]) -> list[Column]:
    """Cholesky factor of ``cov`` plus the ridge, as columns m0.. and l00, l10, ..; unrolled."""
    low: dict[tuple[int, int], Column] = {}
    out = [m.alias(f"m{i}") for i, m in enumerate(mean)]
    for i in range(P):
        for j in range(i + 1):
            x = cov[i, j]
            for k in range(j):
                x = x - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(x, F.lit(RIDGE[i] ** 2))) if i == j else x / low[j, j]
            out.append(low[i, j].alias(f"l{i}{j}"))
    return out


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. by the columns of an estimate, by forward substitution."""
    z: list[Column] = []
    for i in range(P):
        x = F.col(DIMS[i]) - F.col(f"{prefix}m{i}")
        for k in range(i):
            x = x - F.col(f"{prefix}l{i}{k}") * z[k]
        z.append(x / F.col(f"{prefix}l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def sums(rows: DataFrame, by: list[str], scale: float = 1.0) -> DataFrame:
    """n, means a0.. and covariances c00, c10, .. (times ``scale``) of x0.. by ``by``: sums only, so they combine on the map side."""
    means = [F.avg(x).alias(f"a{i}") for i, x in enumerate(DIMS)]
    covs = [(F.covar_pop(DIMS[i], DIMS[j]) * scale).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *means, *covs)


def factored(found: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``sums`` with the mean and the factor of the covariance plus the ridge."""
    cov = {(i, j): F.col(f"c{i}{j}") + F.lit(RIDGE[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)}
    return found.select(*kept, *_factor([F.col(f"a{i}") for i in range(P)], cov))


def moments(rows: DataFrame, by: list[str], scale: float = 1.0) -> DataFrame:
    """Mean and factored covariance of x0.. by ``by``."""
    return factored(sums(rows, by, scale), [*by, "n"])


def chi2_4(x: float) -> float:
    """Share of a chi-square variable with four degrees of freedom that lies below x."""
    from math import exp

    return 1 - exp(-x / 2) * (1 + x / 2)


def chi2_4_at(q: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_4(mid) < q else (low, mid)
    return low


def consistency(support: float) -> float:
    """What the covariance of the nearest ``support`` share is multiplied by, for normal rows."""
    from math import exp

    x = chi2_4_at(support)
    return support / (1 - exp(-x / 2) * (1 + x / 2 + x * x / 8))


def concentrate(rows: DataFrame, by: list[str], support: float, steps: int, name: str, tolerance: float = 1e-3) -> DataFrame:
    """``sums`` of the nearest ``support`` share of each group where its determinant is least, one row a group.

    At most ``steps`` steps from two starts; they end when no group's log determinant falls by more than ``tolerance``.
    """
    quantile = lambda x, q: F.percentile_approx(x, q, 1000)
    centre = rows.groupBy(*by).agg(
        *[quantile(x, 0.5).alias(f"m{i}") for i, x in enumerate(DIMS)],
        *[((quantile(x, 0.75) - quantile(x, 0.25)) / 1.349).alias(f"s{i}") for i, x in enumerate(DIMS)],
    )
    scale = lambda i: F.when(F.col("start") == 0, 1.0).otherwise(F.greatest(F.col(f"s{i}"), F.lit(RIDGE[i])))
    begin = [(scale(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)]
    starts = F.explode(F.array(F.lit(0), F.lit(1))).alias("start")
    key = [*by, "start"]
    estimate = staged(centre.select("*", starts).select(*key, *[f"m{i}" for i in range(P)], *begin), name)
    known_small = small(estimate)
    rows = rows.select(*by, *DIMS)
    log_det = sum((2 * F.log(f"l{i}{i}") for i in range(1, P)), 2 * F.log("l00"))
    before = None
    for _ in range(steps):
        measured = join_small(rows, estimate, by, "inner", known_small).select(*key, *DIMS, distance().alias("d2"))
        within = measured.groupBy(*key).agg(F.percentile_approx("d2", support, 1000).alias("most"))
        near = join_small(measured, within, key, "inner", known_small).where(F.col("d2") <= F.col("most"))
        found = sums(near, key, consistency(support))
        held = [*key, "n", *[f"a{i}" for i in range(P)], *[f"c{i}{j}" for i in range(P) for j in range(i + 1)]]
        estimate = staged(factored(found, held).withColumn("det", log_det), name)
        if before is not None:
            fell = join_small(estimate.select(*key, "det"), before, key, "inner", known_small).agg(F.max(F.col("_det") - F.col("det"))).first()[0]
            if fell is None or fell <= tolerance:
                break
        before = estimate.select(*key, F.col("det").alias("_det"))
    best = estimate.groupBy(*by).agg(F.min_by(F.struct(*held[len(key) :]), F.struct("det", "start")).alias("r"))
    return best.select(*by, "r.*")


def shrunk(own: list[Column], base: list[Column], n: Column, prior: float) -> list[Column]:
    """Means and covariances (a0.., c00, c10, ..) of ``own`` with weight n / (n + prior) and ``base`` with the rest."""
    w = n / (n + F.lit(float(prior)))
    mix = lambda x, y: F.coalesce(w * x + (1 - w) * y, y)
    apart = [x - y for x, y in zip(own[:P], base[:P])]
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    covs = [F.coalesce(w * x + (1 - w) * y + w * w * (1 - w) * apart[i] * apart[j], y) for (i, j), x, y in zip(pairs, own[P:], base[P:])]
    return [mix(x, y) for x, y in zip(own[:P], base[:P])] + covs


def judge(
    stats: DataFrame, support: float = 0.75, steps: int = 8, prior: float = 50, quantile: float = 1 - 1e-7
) -> DataFrame:
    """Adds d2, the squared distance, and kept: not failed by the hard rules and not an outlier.

    ``prior`` is the number of rows that what is known around a group counts as; ``quantile`` is the share of a clean
    normal cloud that lies within the cut.
    """
    none = F.lit("")
    keyed = stats.withColumns(
        {
            "g_lang": F.struct(F.col("lang").isNull().alias("none"), F.coalesce("lang", none).alias("name")),
            "g_source": F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", none).alias("name")),
        }
    )
    keyed = staged(vectors(keyed), "stats")
    rows = keyed.where(~F.col("base_failed")).select("g_lang", "g_source", *DIMS)
    by = ["g_lang", "g_source"]
    names = [*[f"a{i}" for i in range(P)], *[f"c{i}{j}" for i in range(P) for j in range(i + 1)]]
    known = [F.lit(m) for m, _ in PRIOR] + [F.lit(PRIOR[i][1] ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)]
    wide = concentrate(rows, ["g_lang"], support, steps, "mcd-language")
    wide = wide.select("g_lang", *[x.alias(f"w_{c}") for c, x in zip(names, shrunk([F.col(c) for c in names], known, F.col("n"), prior))])
    own = concentrate(rows, by, support, steps, "mcd").join(wide, "g_lang")
    own = own.select(*by, *[x.alias(c) for c, x in zip(names, shrunk([F.col(c) for c in names], [F.col(f"w_{c}") for c in names], F.col("n"), prior))])
    estimate = staged(factored(staged(own, "shrunk"), by), "estimates")
    joined = join_small(keyed, estimate, by, "left", small(estimate))
    return joined.withColumn("d2", distance()).select(
        *stats.columns, "d2", (~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_4_at(quantile), F.lit(True))).alias("kept")
    )


def quality(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, _th, lang, source, statistics, base_failed, d2, kept), a row for each row of ``docs``."""
    return judge(hard_rules(text_stats(docs.select("doc_id", "text", "lang", "source"))), **options)
