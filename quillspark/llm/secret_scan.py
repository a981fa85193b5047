"""Secret scans: pattern spans, and a randomness battery over token-like runs.

All DataFrame code, within each row; no row meets another but in counts. Places
come from the pieces between matches: the k-th match begins after the first k
pieces and the matches before it. They are summed in blocks, so the work is
linear in a text's length. Offsets are code points.

Runs of 20 or more characters of the base64 alphabets outside the base spans
that hold a letter and a digit are tested for randomness under their inferred
encoding: chi-squared uniformity over the alphabet, Wald-Wolfowitz runs about its
middle, and lag-one serial correlation, joined by Fisher's sum. Within each
length class (powers of two) the Benjamini-Hochberg rule at level ``fdr`` decides
which of the distinct tokens are not random; the rest are reported. So the rule
bounds the share of random tokens that are let go, not the share of false
reports: a patterned token is reported when its length is too small for the
battery to tell it (the README has measured figures by length). Runs without a
letter or without a digit are not tested. The rule needs only counts of binned
p-values per class, never all of them in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

# The kinds of base spans in their order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]"
# Alphabets in their order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("lower36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("upper36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "", UPPER + LOWER + DIGITS + "+/"),
)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,token:string>>"
#: Matches per block when their places are summed, and characters per piece when spans are cut out.
BLOCK, PIECE = 256, 16_384


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(text: Column, pattern: str) -> Column:
    """z, an array of (p, m): each match and the piece before it; and rest, the piece after the last."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def both(hits: Column) -> Column:
        pieces = F.split(text, pattern)
        some = _let(pieces, lambda x: F.struct(F.arrays_zip(F.slice(x, 1, F.size(hits)).alias("p"), hits.alias("m")).alias("z"), F.get(x, F.size(hits)).alias("rest")))
        none = F.struct(F.array().cast("array<struct<p:string,m:string>>").alias("z"), text.alias("rest"))
        return F.when(F.size(hits) > 0, some).otherwise(none)

    return _let(hits, both)


def _spans(z: Column, kind: str, keep=None) -> Column:
    """Array of (start, rank, end, kind, token) of the matches; ``keep`` says which matched texts count."""
    size = lambda x: F.length(x["p"]) + F.length(x["m"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda k: F.slice(z, k * BLOCK + 1, BLOCK))

    def begins(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, part: F.struct((acc["at"] + F.aggregate(part, F.lit(0), lambda n, x: n + size(x))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def walk(part: Column, at: Column) -> Column:
        def span(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["p"])
            end = acc["at"] + size(x)
            one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("token"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), span, lambda acc: acc["out"])

    every = _let(blocks, lambda parts: F.flatten(F.zip_with(parts, begins(parts), walk)))
    found = F.when(F.size(z) > 0, every).otherwise(F.array().cast(SPAN))
    return F.filter(found, lambda s: keep(s["token"])) if keep else found


def _blanked(x: Column, keep=None) -> Column:
    """The text with the matches as spaces."""
    blank = lambda m: F.repeat(F.lit(" "), F.length(m))
    one = lambda y: F.concat(y["p"], F.when(keep(y["m"]), blank(y["m"])).otherwise(y["m"]) if keep else blank(y["m"]))
    return F.when(F.size(x["z"]) > 0, F.concat(F.array_join(F.transform(x["z"], one), ""), x["rest"])).otherwise(x["rest"])


def _found(text: Column, min_length: int) -> Column:
    """base, the pattern spans of a text, and tokens, the token-like runs outside them."""
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    like = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    token = TOKEN + "{%d,}" % min_length

    def within(t: Column) -> Column:
        def three(a: Column, b: Column, c: Column) -> Column:
            base = F.concat(_spans(a["z"], "assign", long_value), _spans(b["z"], "access"), _spans(c["z"], "hex"))
            # each pattern's matches are blanked in what the one before has left
            rest = _let(_blanked(a, long_value), lambda x: _let(_split(x, ACCESS), lambda y: _let(_blanked(y), lambda v: _let(_split(v, HEX), lambda w: _blanked(w)))))
            more = _let(_let(rest, lambda r: _split(r, token)), lambda x: _spans(x["z"], "random", like))
            return F.struct(base.alias("base"), more.alias("tokens"))

        return _let(_split(t, ASSIGN), lambda a: _let(_split(t, ACCESS), lambda b: _let(_split(t, HEX), lambda c: three(a, b, c))))

    return _let(text, within)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _upper_normal(z: Column) -> Column:
    """1 - Phi(z), by the rational approximation of erfc (error under 1.2e-7 of the value)."""
    x = F.abs(z) / (2.0**0.5)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the public Chebyshev fit of erfc.
    poly = F.lit(0.17087277)
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + a
    tail = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """n, encoding, p_chi, p_runs, p_serial and p (Fisher) of a token of two characters or more."""
    name, alphabet = F.lit(ALPHABETS[-1][0]), F.lit(ALPHABETS[-1][2])
    for n, pattern, letters in reversed(ALPHABETS[:-1]):
        name, alphabet = F.when(token.rlike(pattern), n).otherwise(name), F.when(token.rlike(pattern), letters).otherwise(alphabet)
    plain = F.translate(token, "-_", "+/")
    return _let(F.struct(name.alias("encoding"), alphabet.alias("abc"), plain.alias("s")), _tested)


def _tested(t: Column) -> Column:
    s, abc = t["s"], t["abc"]
    n, k = F.length(s).cast("double"), F.length(abc).cast("double")
    squares = F.aggregate(
        F.sequence(F.lit(1), F.length(abc)),
        F.lit(0.0),
        lambda a, i: a + F.pow((F.length(s) - F.length(F.replace(s, F.substring(abc, i, F.lit(1)), F.lit("")))).cast("double"), F.lit(2.0)),
    )
    chi, df = squares * k / n - n, k - 1
    spread = 2 / (9 * df)
    p_chi = _upper_normal((F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - spread)) / F.sqrt(spread))
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.position(c, abc).cast("double") - 1)
    # one walk over the characters: those of the alphabet's upper half, runs, sums, squares and lagged products
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("n1", "runs", "sum", "sq", "lag")), F.lit(None).cast("double").alias("last"), F.lit(None).cast("double").alias("first"))

    def step(acc: Column, v: Column) -> Column:
        high, was = v >= k / 2, acc["last"] >= k / 2
        return F.struct(
            (acc["n1"] + high.cast("double")).alias("n1"),
            (acc["runs"] + F.when(acc["last"].isNull() | (high != was), 1.0).otherwise(0.0)).alias("runs"),
            (acc["sum"] + v).alias("sum"),
            (acc["sq"] + v * v).alias("sq"),
            (acc["lag"] + F.coalesce(acc["last"] * v, F.lit(0.0))).alias("lag"),
            v.alias("last"),
            F.coalesce(acc["first"], v).alias("first"),
        )

    def joined(w: Column) -> Column:
        n1, n2 = w["n1"], n - w["n1"]
        mu = 2 * n1 * n2 / n + 1
        var = F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9))
        p_runs = F.when((n1 == 0) | (n2 == 0), F.pow(F.lit(2.0), 1 - n)).otherwise(2 * _upper_normal(F.abs(w["runs"] - mu) / F.sqrt(var)))
        mean = w["sum"] / n
        ss = w["sq"] - n * mean * mean
        lag = w["lag"] - mean * (2 * w["sum"] - w["first"] - w["last"]) + (n - 1) * mean * mean
        p_serial = F.when(ss <= 1e-9, F.lit(1e-12)).otherwise(2 * _upper_normal(F.abs(lag / ss + 1 / n) * F.sqrt(n)))
        floor = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))

        def fisher(x: Column) -> Column:
            half = -(F.ln(floor(x["p_chi"])) + F.ln(floor(x["p_runs"])) + F.ln(floor(x["p_serial"])))
            return F.struct(n.cast("int").alias("n"), t["encoding"].alias("encoding"), *(x[c].alias(c) for c in ("p_chi", "p_runs", "p_serial")), (F.exp(-half) * (1 + half + half * half / 2)).alias("p"))

        return _let(F.struct(p_chi.alias("p_chi"), p_runs.alias("p_runs"), p_serial.alias("p_serial")), fisher)

    return _let(F.aggregate(codes, zero, step), joined)


def fdr_thresholds(p: DataFrame, fdr: float, width: float = 0.05, top: int = 240) -> DataFrame:
    """(size_class, reject_at): per length class, the greatest bin of -log10 p (from
    the small p-values up) whose share of expected false rejections is ``fdr`` at most."""
    from pyspark.sql import Window

    bins = F.least(_bin(F.col("p"), width), F.lit(top))
    counts = p.groupBy("size_class", bins.alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("size_class")
    run = counts.withColumn("total", F.sum("m").over(w)).withColumn("first", F.sum("m").over(w.orderBy(F.desc("bin"))))
    # the largest p of a bin is 10 ** -(bin * width)
    ok = run.where(F.pow(F.lit(10.0), -F.col("bin") * width) <= fdr * F.col("first") / F.col("total"))
    return ok.groupBy("size_class").agg(F.min("bin").alias("reject_at")).withColumn("width", F.lit(width))


def _bin(p: Column, width: float) -> Column:
    return F.floor(-F.log10(F.greatest(p, F.lit(1e-12))) / width).cast("int")


def scan_secrets(docs: DataFrame, fdr: float = 0.01, min_length: int = 20, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of ``docs``: row (a struct of its columns ``carry``), base and more (arrays of spans).

    base holds the pattern spans, more the random tokens of what is left of the
    text when base spans are blanked. Null and empty texts have none. Each row is
    judged by itself, but for the thresholds: over all distinct tokens. Rows with equal
    texts get equal spans; ids may be null or repeat; an empty table gives none;
    columns that are not carried are not read, whatever their names.
    """
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), _found(texts(), min_length).alias("found"))
    test = lambda s: _let(battery(s["token"]), lambda x: F.struct(s.alias("span"), F.floor(F.log2(x["n"])).cast("int").alias("size_class"), x["p"].alias("p")))
    d = cut(d.select("row", "found.base", F.transform("found.tokens", test).alias("tokens")), "spans")
    each = d.where(F.size("tokens") > 0).select(F.explode("tokens").alias("x")).select("x.span.token", "x.size_class", "x.p").distinct()
    # a row per power of two that a length can have: 31 at most
    limits = fdr_thresholds(each, fdr).collect()

    def random(x: Column) -> Column:
        out = F.lit(True)
        for r in limits:
            out = F.when(x["size_class"] == r.size_class, _bin(x["p"], r.width) < r.reject_at).otherwise(out)
        return out

    return d.select("row", "base", F.transform(F.filter("tokens", random), lambda x: x["span"]).cast(SPAN).alias("more"))


def secret_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs, **options).select(
        "row.doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "more")).alias("spans")
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every character under a span gone; each run of spans that overlap becomes ``mark``.

    A text is cut into pieces (possessively: Java's greedy bounded repeats recurse over
    characters of changing width), and each takes the spans that reach into it.
    """

    def cut_out(piece: Column, begin: Column, own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            start, end = s["start"] - begin, s["end"] - begin
            fresh = F.struct(end.alias("at"), F.concat(acc["out"], F.substring(piece, acc["at"] + 1, start - acc["at"]), F.lit(mark)).alias("out"))
            return F.when(start >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out")))

        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.lit(PIECE))))

    def pieces(whole: Column, at: Column, near: Column, size: int, inner) -> Column:
        reach = lambda k: F.filter(near, lambda s: (s["start"] < at + (k + 1) * size) & (s["end"] > at + k * size))
        every = F.regexp_extract_all(whole, F.lit("(?s).{1,%d}+" % size), F.lit(0))
        return F.array_join(F.transform(every, lambda piece, k: _let(reach(k), lambda own: F.when(F.size(own) > 0, inner(piece, at + k * size, own)).otherwise(piece))), "")

    small = lambda whole, at, near: pieces(whole, at, near, PIECE, cut_out)
    return F.when(F.size(spans) > 0, _let(F.array_sort(spans), lambda s: pieces(text, F.lit(0), s, 64 * PIECE, small))).otherwise(text)
