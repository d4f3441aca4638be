"""Quality rules and robust multivariate outliers, with DataFrame functions only.

Per text: words, characters in words, symbols, repeated lines, words in repeated 3-word windows. Texts
that pass the base rules are judged by their statistic vector: log mean word length, log symbols per
100 words, share of repeated words, repeated lines per 100 words (log). Location and scatter are
estimated per language and source by minimum covariance determinant:

* nine starts a group (medians; one coordinate moved to its lower or upper quartile), whose concentration steps
  re-estimate mean and covariance from the ``share`` of rows nearest to the last estimate, here half of them;
* of the starts the one with the least determinant goes on until no group's determinant falls any more;
* rows within the 97.5 % quantile of the estimate so found give the final mean and covariance, made consistent.

A group of n rows is judged by the mixture of n parts of its own estimate and ``PRIOR`` parts of its language's, which
itself is mixed with that of all rows; so small groups need no rule of their own. A row is rejected where its squared
Mahalanobis distance is over ``cutoff``.

Rows are summed by group, start and cell of distance (bounded in number), one pass a step, so quantiles need no sort
of a group and a source with a third of all rows is pre-aggregated in every task.

Defined results: a null text has no words and fails the base rules; null languages and sources are
groups of their own; a statistic without spread gets a floor, so groups of equal rows reject
nothing; an empty table gives no rows; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, SPACES, beside, written

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
FLOORS = (0.06, 0.35, 0.06, 0.35)
CUTOFF = 40.0
SHARE, PRIOR = 0.5, 50.0
#: Of the chi-square distribution with 4 degrees of freedom: median, 97.5 % quantile, and the factor that makes a covariance of rows within that consistent.
CHI_MEDIAN, CHI_UPPER, CONSISTENT = 3.357, 11.143, 1.0645
_TRIM = " \t\n\x0b\f\r"


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(_TRIM))
    d = docs.select(*keep, text.alias("text"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_TRIM))) > 0)
    hashed = F.when(F.size("words") >= 4, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    d = d.select(*keep, F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), lines.alias("lines"), hashed.alias("hashed"))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    twice = F.coalesce(F.size(F.array_distinct("hashed")) < F.size("hashed"), F.lit(False))
    d = d.withColumn("ordered", F.when(twice, F.sort_array(F.transform("hashed", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("ordered")
    same = lambda x, k: F.coalesce(F.get("ordered", k)["h"] == x["h"], F.lit(False))
    found = F.filter("ordered", lambda x, k: same(x, k - 1) | ((k + 1 < n) & same(x, k + 1)))
    d = d.withColumn("found", F.sort_array(F.transform(found, lambda x: x["i"])))
    gaps = F.zip_with("found", F.slice("found", F.lit(2), F.size("found")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.when(F.col("found").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars") / words, F.lit(0.1))),
        F.log1p(100.0 * F.col("n_symbols") / words),
        F.col("n_repeat_words") / words,
        F.log1p(100.0 * F.col("n_dup_lines") / words),
    ]


X = [f"x{i}" for i in range(4)]
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def _cell(d2: Column) -> Column:
    """Bounded cells of a squared distance, 50 to a power of e."""
    return F.least(F.floor(F.log1p(d2) * 50), F.lit(2500)).cast("int")


def _factored(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_ij of the covariance c_ij, whose diagonal gets its floor, and the log of the determinant."""
    for i in range(4):
        for j in range(i + 1):
            v = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0))
            if i == j:
                v = v + F.lit(FLOORS[i] ** 2)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            v = F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 / 100))) if i == j else v / F.col(f"l{j}{j}")
            params = params.withColumn(f"l{i}{j}", v)
    return params.withColumn("det", sum((2 * F.log(f"l{i}{i}") for i in range(1, 4)), 2 * F.log("l00")))


M = [f"m{i}" for i in range(4)]
C, L = [f"c{i}{j}" for i, j in PAIRS], [f"l{i}{j}" for i, j in PAIRS]


def _distances(df: DataFrame) -> DataFrame:
    """df (x0..x3, m, l) with d2: the squared Mahalanobis distance."""
    cols = [c for c in df.columns if c not in (*M, *L)]
    for i in range(4):
        y = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return df.select(*cols, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, 4)), F.col("y0") * F.col("y0")).alias("d2"))


def _cells(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """Per group, start and cell of distance: rows, their sums and sums of products; then rows up to the cell, all rows, and the cell of the median."""
    packed = params.groupBy("grp").agg(F.collect_list(F.struct("start", *M, *L)).alias("p"))
    d = beside(rows, packed, ["grp"], few).select("grp", *X, F.explode("p").alias("p")).select("grp", *X, "p.*")
    n = _distances(d).groupBy("grp", "start", _cell(F.col("d2")).alias("cell")).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in PAIRS])
    every = Window.partitionBy("grp", "start")
    n = n.withColumn("upto", F.sum("n").over(every.orderBy("cell"))).withColumn("all", F.sum("n").over(every))
    return n.withColumn("half", F.min(F.when(F.col("upto") >= 0.5 * F.col("all"), F.col("cell"))).over(every))


def _moments(cells: DataFrame) -> DataFrame:
    """Mean, covariance, its factor and determinant of the rows in some cells."""
    s = cells.groupBy("grp", "start").agg(F.max("all").alias("all"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in (*[f"s{i}" for i in range(4)], *[f"p{i}{j}" for i, j in PAIRS])])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(4)]
    s = s.select("grp", "start", "all", *[mean[i].alias(f"m{i}") for i in range(4)], *[(F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in PAIRS])
    return _factored(s)


def mcd(rows: DataFrame, share: float = SHARE, steps: int = 3, most_steps: int = 20) -> DataFrame:
    """rows: grp, x0..x3. Per group: all (its rows), mean m, covariance c, factor l, det of the raw estimate before reweighting."""
    q = written(rows.groupBy("grp").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, x in enumerate(X)]), "rules-quartiles")
    few = q.limit(FEW + 1).count() <= FEW
    starts = [[1] * 4, *[[1 if k != i else v for k in range(4)] for i in range(4) for v in (0, 2)]]
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), *[F.col(f"q{i}")[v].alias(f"m{i}") for i, v in enumerate(s)]) for k, s in enumerate(starts)]))
    spread = [((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349).alias(f"w{i}") for i in range(4)]
    begin = q.select("grp", at.alias("at"), *spread).select("grp", "at.*", *[(F.col(f"w{i}") * F.col(f"w{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    params = written(_factored(begin), "rules-mcd")

    def step(params: DataFrame) -> DataFrame:
        cells = _cells(rows, params, few)
        return written(_moments(cells.where(F.col("upto") - F.col("n") < F.ceil(share * F.col("all")))), "rules-mcd")

    for _ in range(steps):
        params = step(params)
    least = lambda df: written(df.groupBy("grp").agg(F.min(F.struct("det", "start", "all", *M, *C, *L)).alias("b")).select("grp", "b.*"), "rules-mcd")
    best = least(params)
    for _ in range(most_steps):
        new = step(best)
        fell = new.join(best.select("grp", F.col("det").alias("was")), "grp").agg(F.max(F.col("was") - F.col("det"))).first()[0]
        best = least(best.unionByName(new))
        if fell is None or fell < 1e-3:
            break
    cells = _cells(rows, best, few)
    scale = F.greatest(F.lit(1.0), F.expm1((F.col("half") + 1) / 50.0) / CHI_MEDIAN)
    out = _moments(cells.where(F.col("cell") <= _cell(scale * CHI_UPPER))).drop("det", "start", *L)
    out = out.withColumns({c: F.col(c) * CONSISTENT for c in C}).join(best.select("grp", "det"), "grp")
    return written(_factored(out.withColumnRenamed("det", "raw")).drop("det").withColumnRenamed("raw", "det"), "rules-mcd")


def _mixed(own: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """own estimates (all, m, c, key of the parent) as mixtures with those of their parents: n parts to PRIOR parts."""
    p = parent.select(F.col("grp").alias(key), *[F.col(c).alias(f"p_{c}") for c in (*M, *C)])
    d = own.join(p, key).withColumn("w", F.col("all") / (F.col("all") + PRIOR))
    mix = lambda c: F.col("w") * F.col(c) + (1 - F.col("w")) * F.col(f"p_{c}")
    apart = lambda i, j: F.col("w") * (1 - F.col("w")) * (F.col(f"m{i}") - F.col(f"p_m{i}")) * (F.col(f"m{j}") - F.col(f"p_m{j}"))
    rest = [c for c in own.columns if c not in (*M, *C, *L)]
    return d.select(*rest, *[mix(c).alias(c) for c in M], *[(mix(f"c{i}{j}") + apart(i, j)).alias(f"c{i}{j}") for i, j in PAIRS])


def estimates(judged: DataFrame, share: float = SHARE) -> DataFrame:
    """judged: lang, source (as keys, never null), x0..x3. grp (language and source) with its mixed estimate m, c, l."""
    one, two = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang"))
    levels = F.explode(F.array(one, two, F.lit("all")))
    params = mcd(judged.select(levels.alias("grp"), *X), share)
    groups = written(judged.select(one.alias("grp"), two.alias("two")).distinct().withColumn("every", F.lit("all")), "rules-groups")
    langs = groups.select(F.col("two").alias("grp"), "every").distinct()
    everything = params.where("grp = 'all'")
    lang = _mixed(langs.join(params, "grp"), everything, "every")
    return written(_factored(_mixed(groups.join(params, "grp"), lang, "two")), "rules-estimates")


def quality_rules(docs: DataFrame, share: float = SHARE, cutoff: float = CUTOFF) -> DataFrame:
    """docs: doc_id, text, lang, source. Per row: doc_id, the statistics, base_failed, distance, kept."""
    stats = written(statistics(docs, "doc_id", "lang", "source"), "rules-statistics").withColumns(dict(zip(X, _vector(), strict=True)))
    named = [F.coalesce(F.concat(F.lit("="), c), F.lit("null")).alias(c) for c in ("lang", "source")]
    good = stats.where("not base_failed")
    params = estimates(written(good.select(*named, *X), "rules-vectors"), share)
    out = good.withColumn("grp", F.to_json(F.array(*named)))
    out = _distances(beside(out, params.select("grp", *M, *L), ["grp"])).withColumn("distance", F.col("d2"))
    rest = stats.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance"]
    return out.select(*cols).unionByName(rest.select(*cols)).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False)))


def query(docs: DataFrame) -> DataFrame:
    return quality_rules(docs)
