"""Quality rules: base counts, and robust multivariate outliers by group.

Everything here is DataFrame code. The text is read once; the counts go to a
narrow table in the shared folder, and all passes of the estimator run on that.

Minimum covariance determinant, per (lang, source): there are three starts
about the coordinate-wise median (quartile spreads; covariances of hyperbolic
tangents; spatial signs). Concentration steps take mean and covariance of the half
of the rows that lie nearest; after ``steps`` of them, the start whose covariance
has the least determinant goes on for ``more`` steps; that is the least of three
local minima, not proven to be the least of all halves. Each step is two
aggregations that combine map-side; the half is found by a mergeable quantile
sketch, so a group with a third of all rows is never gathered in one task. The
sketch is exact up to ``accuracy`` rows in a group; beyond, the half's share is off by
1 / ``accuracy`` at most, so of 2,000 rows one more or less may count.
The same fit is made per language and over all rows. A group is judged by its
own estimate, shrunk towards its language's as if that stood for ``min_rows``
rows in the covariance and for as many rows as there are statistics in the
mean; a language's is shrunk towards that of all rows alike. So the weight of a
group's own rows grows smoothly with their number; no count switches the method.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, texts

_WS = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"
#: A group's rows meet its estimate in so many parts.
SALTS = 32

#: Least standard deviation of each transformed statistic. It keeps a
#: statistic that is 0 in most rows from making one odd line an outlier.
FEATURES = {"f_word": 0.35, "f_symbol": 0.8, "f_upper": 0.6, "f_repeat": 1.5, "f_line": 0.15}


def base_counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, row (a struct of the columns ``carry``) and the counts of each row of ``docs``.

    A null text has no words, like an empty one. Missing lang or source
    columns count as null. Repeated rows stay repeated.
    """
    have = set(docs.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    row = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("struct<none:boolean>")
    d = docs.select("doc_id", col("lang").alias("lang"), col("source").alias("source"), row.alias("row"), texts().alias("t"))
    d = d.withColumn("s", F.trim(F.col("t"), F.lit(_TRIM)))
    d = d.withColumn("w", F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split("s", _WS)))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(_TRIM)) != "")
    d = d.withColumn("lines", lines).withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn(
        "h",
        F.when(
            F.col("n_words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # windows sorted by hash: equal ones are neighbours
    d = d.withColumn(
        "z",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    twice = F.transform(
        F.filter("z", lambda x, i: (x["h"] == F.get("z", i - 1)["h"]) | (x["h"] == F.get("z", i + 1)["h"])),
        lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
    )
    only = lambda chars: F.length(F.regexp_replace("t", f"[^{chars}]+", "")).cast("long")
    return d.select(
        "doc_id",
        "lang",
        "source",
        "row",
        "n_words",
        F.length(F.regexp_replace("t", _WS, "")).cast("long").alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("z").isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(twice)))).cast("long").alias("n_repeat_words"),
        only("A-Z").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _transformed(counts: DataFrame) -> DataFrame:
    """The statistic vector of each row, and whether the base rules fail it."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "f_word": F.log1p(per("word_chars", "n_words")) * 2,
            "f_symbol": F.log1p(1000 * per("n_symbols", "word_chars")),
            "f_upper": F.log1p(1000 * per("n_upper", "word_chars")),
            "f_repeat": F.log1p(1000 * per("n_repeat_words", "n_words")),
            "f_line": per("n_dup_lines", "n_lines"),
        }
    )


def _cholesky(p: int, names: list[str], var: str = "c") -> tuple[list[tuple[str, Column]], list[str]]:
    """Columns l_i_j of the lower factor of the covariances c_i_j, each from those before it."""
    out = []
    for j in range(p):
        for i in range(j, p):
            s = F.col(f"{var}_{i}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out.append((f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l_{j}_{j}")))
    return out, [n for n, _ in out]


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution through l_i_j."""
    y: list[Column] = []
    for i, n in enumerate(names):
        s = F.col(n) - F.col(f"m_{i}")
        for k in range(i):
            s = s - F.col(f"l_{i}_{k}") * y[k]
        y.append(s / F.col(f"l_{i}_{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


#: Starts of the concentration steps.
STARTS = ("spread", "tanh", "sign")


def _spread_out(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))


def _starts(rows: DataFrame, key: str, accuracy: int) -> DataFrame:
    """key, start, n_rows, m_i and c_i_j of each group's starts."""
    names, floors = list(FEATURES), list(FEATURES.values())
    p = len(names)
    pairs = [(i, j) for j in range(p) for i in range(j, p)]
    quart = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.percentile_approx(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy).alias(f"q_{i}") for i, n in enumerate(names)),
    )
    spread = lambda i: F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(floors[i]))
    at = cut(quart.select(key, "n_rows", *(F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)), *(spread(i).alias(f"s_{i}") for i in range(p))), "mcd")
    z = rows.join(_spread_out(at), [key, "salt"]).withColumns({f"z_{i}": (F.col(n) - F.col(f"m_{i}")) / F.col(f"s_{i}") for i, n in enumerate(names)})
    z = z.withColumn("far", F.greatest(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(p)), F.lit(0.0)), F.lit(1e-12)))
    tanh = {(i, j): F.covar_pop(F.tanh(f"z_{i}"), F.tanh(f"z_{j}")) for i, j in pairs}
    sign = {(i, j): F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("far")) * p for i, j in pairs}
    found = z.groupBy(key).agg(
        F.struct(*((F.lit(1.0) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs)).alias("spread"),
        *(F.struct(*(c[i, j].alias(f"c_{i}_{j}") for i, j in pairs)).alias(k) for k, c in (("tanh", tanh), ("sign", sign))),
    )
    found = found.select(F.col(key).alias("of"), F.explode(F.array(*(F.struct(F.lit(k).alias("start"), F.col(k).alias("c")) for k in STARTS))).alias("x"))
    found = at.join(found, F.col(key) == F.col("of"))
    scaled = lambda i, j: F.col(f"x.c.c_{i}_{j}") * F.col(f"s_{i}") * F.col(f"s_{j}") + (floors[i] ** 2 if i == j else 0.0)
    return found.select(key, "x.start", "n_rows", *(f"m_{i}" for i in range(p)), *(scaled(i, j).alias(f"c_{i}_{j}") for i, j in pairs))


def _concentrated(rows: DataFrame, at: DataFrame, key: str, share: float, accuracy: int) -> DataFrame:
    """Mean and covariance of the nearest rows, for each of the estimates ``at`` of a group."""
    names, floors = list(FEATURES), list(FEATURES.values())
    p = len(names)
    # consistency: the covariance of the nearest half understates that of a Gaussian
    correct = share / _chi2_cdf(_chi2_quantile(share, p), p + 2)
    for n, c in _cholesky(p, names)[0]:
        at = at.withColumn(n, c)
    lower = [f"l_{i}_{j}" for j in range(p) for i in range(j, p)]
    far = rows.join(_spread_out(at.select(key, "start", "n_rows", *(f"m_{i}" for i in range(p)), *lower)), [key, "salt"]).withColumn("d", _distance(names))
    near = far.groupBy(key, "start").agg(F.percentile_approx("d", F.lit(share), accuracy).alias("cut_d"))
    half = far.select(key, "start", "salt", "n_rows", "d", *names).join(_spread_out(near), [key, "start", "salt"]).where(F.col("d") <= F.col("cut_d"))
    out = half.groupBy(key, "start").agg(
        F.max("n_rows").alias("n_rows"),
        *(F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)),
        *(F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for j in range(p) for i in range(j, p)),
    )
    return out.withColumns({f"c_{i}_{j}": F.col(f"c_{i}_{j}") * correct + (floors[i] ** 2 if i == j else 0.0) for j in range(p) for i in range(j, p)})


def _fit(rows: DataFrame, key: str, steps: int, more: int, share: float, accuracy: int) -> DataFrame:
    """key, n_rows, m_i, c_i_j, and the start that won, of each group of ``rows``."""
    p = len(FEATURES)
    # a row's statistics choose its salt, so that a hot group is dealt over many tasks
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)))
    at = cut(_starts(rows, key, accuracy), "mcd")
    for _ in range(steps):
        before, at = at, cut(_concentrated(rows, at, key, share, accuracy), "mcd")
        discard(before)
    det = at
    for n, c in _cholesky(p, list(FEATURES))[0]:
        det = det.withColumn(n, c)
    det = det.withColumn("log_det", F.round(sum((F.log(F.col(f"l_{i}_{i}")) for i in range(p)), F.lit(0.0)), 9))
    columns = [c for c in at.columns if c != key]
    # the least determinant; of equals the first start by name
    best = det.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("x"))
    at = cut(best.select(key, "x.*"), "mcd")
    for _ in range(more):
        before, at = at, cut(_concentrated(rows, at, key, share, accuracy), "mcd")
        discard(before)
    return at


def _shrunk(own: DataFrame, wider: DataFrame, on: str, weight: float) -> DataFrame:
    """``own`` with covariances shrunk towards those of ``wider``, which count as
    ``weight`` rows, and means likewise, where they count as one row a statistic."""
    p = len(FEATURES)
    means, spreads = [f"m_{i}" for i in range(p)], [f"c_{i}_{j}" for j in range(p) for i in range(j, p)]
    d = own.join(wider.select(F.col("g").alias(on), *(F.col(v).alias(f"w{v}") for v in means + spreads)), on)

    def mix(v: str, rows: float) -> Column:
        w = F.col("n_rows") / (F.col("n_rows") + F.lit(float(rows)))
        return (w * F.col(v) + (1 - w) * F.col(f"w{v}")).alias(v)

    return d.select("g", "n_rows", *(mix(v, p) for v in means), *(mix(v, weight) for v in spreads))


def _chi2_cdf(x: float, k: int) -> float:
    """Lower regularised gamma function of k/2, by its series."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > 1e-16 * total:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _chi2_quantile(q: float, k: int) -> float:
    lo, hi = 1e-9, 10.0 * k + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < q else (lo, mid)
    return lo


def quality_rules(
    docs: DataFrame,
    min_rows: int = 100,
    steps: int = 2,
    more: int = 2,
    share: float = 0.5,
    keep_quantile: float = 0.9999,
    accuracy: int = 2000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, distance, kept, and with
    ``carry`` a struct ``row`` of these columns.

    kept is false where base_failed; else where the squared distance to the
    group's estimate exceeds the chi-squared quantile ``keep_quantile``. At
    ``min_rows`` rows a group's own covariance and its language's weigh the same.
    Null texts have no words and fail the base rule. Null lang or source form
    groups of their own. Repeated rows, and rows that share an id, are judged each.
    Ties in a distance are in or out of the nearest half together. Empty tables give
    none. Columns other than doc_id, text, lang and source are not read.
    """
    f = cut(_transformed(base_counts(docs, carry)), "counts")
    usable = f.where(~F.col("base_failed"))
    lang, source = F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))
    full = F.concat_ws("\x01", F.lit("g"), lang, source)
    by_lang = F.concat_ws("\x01", F.lit("l"), lang)
    rows = usable.select(F.explode(F.array(full, by_lang, F.lit("all"))).alias("g"), *FEATURES)
    at = _fit(rows, "g", steps, more, share, accuracy)
    # a group's key holds its language's
    langs = _shrunk(at.where(F.col("g").startswith("l\x01")).withColumn("up", F.lit("all")), at, "up", min_rows)
    up = F.concat_ws("\x01", F.lit("l"), F.split("g", "\x01")[1])
    at = _shrunk(at.where(F.col("g").startswith("g\x01")).withColumn("up", up), langs, "up", min_rows)
    for n, c in _cholesky(len(FEATURES), list(FEATURES))[0]:
        at = at.withColumn(n, c)
    at = cut(at.drop("n_rows"), "mcd")
    limit = _chi2_quantile(keep_quantile, len(FEATURES))
    out = f.withColumn("g", full).join(at, "g", "left")
    distance = F.when(F.col("base_failed"), F.lit(None)).otherwise(_distance(list(FEATURES)))
    return out.withColumn("distance", distance).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"),
        "distance",
        *(["row"] if carry else []),
    )
