"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What redaction hides, in order.
BEARER = r"(?i)\bbearer\s+[^\s,;\"']+"
URL = r"(?i)\b(?:https?|wss?)://[^\s\"'<>]+"
PARAM = r"(?i)(x-amz-(?:signature|credential|security-token)|signature|token|access_token|authorization)=([^&\s,;]+)"


def redact(c: Column, limit: int | None = 500) -> Column:
    """Bearer values, then whole URLs, then secret parameters; cut to ``limit`` characters."""
    out = F.regexp_replace(c, BEARER, "Bearer [REDACTED]")
    out = F.regexp_replace(out, URL, "[redacted-url]")
    out = F.regexp_replace(out, PARAM, "$1=[REDACTED]")
    return out if limit is None else F.substring(out, 1, limit)


def endpoint(url: Column) -> Column:
    """Host, port and path of an address: user, query and fragment never show."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^.*@", "")
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), F.concat(F.lower(host), F.regexp_extract(rest, r"^[^/]*(.*)$", 1))).otherwise("[redacted-url]")


def minimal_number(x: Column) -> Column:
    """Whole values without a point, others as they print."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def head_tail(c: Column, edge: int) -> Column:
    """Both ends of a long text, and how much is left out between them."""
    n = F.length(c)
    gap = F.concat(F.lit("\n... "), (n - 2 * edge).cast("string"), F.lit(" chars omitted ...\n"))
    return F.when(n <= 2 * edge, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(edge))), gap, F.ltrim(F.right(c, F.lit(edge)))))


def last_json(c: Column) -> Column:
    """The last JSON object without inner ones in a text."""
    return F.element_at(F.regexp_extract_all(c, F.lit(r"\{[^{}]*\}"), F.lit(0)), -1)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys sorted."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def jid_claim(token: Column) -> Column:
    """The ``jid`` of a token's claims (base64url before the last dot); empty where they can't be read."""
    body = F.translate(F.regexp_replace(token, r"\.[^.]*$", ""), "-_", "+/")
    whole = F.rpad(body, F.ceil(F.length(body) / 4).cast("int") * 4, F.lit("="))
    text = F.try_to_binary(whole, F.lit("base64")).try_cast("string")
    return F.coalesce(F.trim(F.get_json_object(text, "$.jid")), F.lit(""))


def colour(name: Column, default: Column, known: dict[str, str]) -> Column:
    """A named colour, else the default's, else white."""
    of = lambda c: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in known.items()))
    return F.coalesce(of(name), of(default), F.lit("255,255,255"))


def object_key(url: Column) -> Column:
    """Host and path of an http address, without its query; else null."""
    return F.when(url.rlike("^https?://"), F.regexp_extract(url, r"^https?://([^?#]*)", 1))


def timecode(t: Column) -> Column:
    """H:MM:SS.cc of seconds."""
    cs = F.round(t * 100).cast("long")
    part = lambda d, m: F.expr("0") if m is None else F.pmod(F.floor(cs / d), F.lit(m))
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), part(6000, 60), part(100, 60), F.pmod(cs, F.lit(100)))


def subtitle_colour(rgb: Column) -> Column:
    """#rrggbb as &H00BBGGRR."""
    return F.upper(F.concat(F.lit("&H00"), F.substring(rgb, 6, 2), F.substring(rgb, 4, 2), F.substring(rgb, 2, 2)))


def clean_caption(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(c, r"[{}.,!?;:]+", "")))


def greedy_lines(c: Column, width: int) -> Column:
    """Words laid into lines of at most ``width`` characters, each line as long as it can be."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    return F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda acc, w: F.when(
            (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(w) <= width),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), w))),
        ).otherwise(F.concat(acc, F.array(w))),
    )
