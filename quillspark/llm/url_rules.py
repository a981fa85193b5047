"""URL filters: stated host and path rules, and mined association rules.

All DataFrame code. URLs become sets of tokens (host labels, path words, query
keys, ...). Tokens that stand in the same labelled URLs are merged into one item
before mining: rules with any of them have the same support, confidence and lift,
so a URL holds an item if it holds one of its tokens. Spark's FP-growth mines the combinations that go with a bad
label. The number of itemsets is exponential in a basket's items, so FP-growth
gets the baskets of up to ``most_items`` items, each whole. A combination that no longer
bad basket holds has all its support there. Those that a longer one holds are
grown by rounds over all baskets, projected as FP-growth does it, and only as long as a rule may
come of them: nothing is left out. The rules' counts are then taken anew from the
whole baskets. Those of enough support, confidence and lift become rules; for
verdicts the least ones do, as a URL that holds a rule holds each rule inside it.
An inverted index holds each rule under the tokens of its rarest item; a
token set is matched through the index, and a rule fires if the set holds all its
items. Token sets are matched once each, however many URLs share one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"


@dataclass(frozen=True)
class HostRule:
    """Holds for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


# The stated rules.
STATED = (
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def stated_rule(rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the columns host and path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: str = "url") -> Column:
    """Sorted distinct tokens of the columns host, path and ``url``; numbers count as one token."""
    tag = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    plain = lambda c: F.regexp_replace(F.translate(c, UPPER, LOWER), "[0-9]+", "0")
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    return F.array_sort(
        F.array_distinct(
            F.concat(
                tag("h:", F.split(plain(F.col("host")), r"\.")),
                tag("w:", F.filter(F.split(plain(F.col("host")), r"[.-]"), lambda x: F.col("host").contains("-") & (F.length(x) > 2))),
                tag("p:", F.split(plain(F.col("path")), r"[/.]")),
                tag("q:", F.transform(F.split(plain(query), "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
            )
        )
    )


def _merged(baskets: DataFrame) -> DataFrame:
    """(token, item, tokens, n, n_bad): the tokens of each item, which stand in the same baskets. Item is the least of them."""
    each = baskets.select("basket", "bad", F.explode("tokens").alias("token"))
    # equal sets of baskets have equal counts and equal sums of two hashes
    hashed = lambda seed: F.sum(F.xxhash64("basket", F.lit(seed)).cast("decimal(20,0)")).alias(f"s{seed}")
    of = cut(each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), hashed(1), hashed(2)), "tokens")
    items = of.groupBy("n", "n_bad", "s1", "s2").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return items.select(F.explode("tokens").alias("token"), F.get("tokens", F.lit(0)).alias("item"), "tokens", "n", "n_bad")


def _grown(front: DataFrame, passes, least: int, least_only: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(items) of the rules that a long bad basket holds, and the tables that this reads.

    FP-growth by rounds: a row (x, of, tail, n, n_bad, n_long) of ``front`` stands for n baskets, n_long of them bad and long, that hold x
    and, of the items that may follow x in the items' order, those in tail; ``of`` baskets hold x in all. A round counts each x with one item
    more. It goes on from those of ``least`` bad baskets, unless a rule is excluded: baskets that are good and hold x and all
    that may follow stay in every set grown from x, and its bad ones are those of the best next item at most. With
    ``least_only`` sets end that are a rule, or have an item that the others imply, and what contains such a set is not counted.
    """
    sums = [F.sum(k).alias(k) for k in ("n", "n_bad", "n_long")]
    rounds: list[DataFrame] = []
    while not front.isEmpty():
        grown = front.select("x", "of", F.explode("tail").alias("item"), "n", "n_bad", "n_long").groupBy("x", "of", "item").agg(*sums)
        grown = grown.where((F.col("n_bad") >= least) & (F.col("n_long") > 0))
        for done in rounds if least_only else ():
            # the last item of a set is the last of each ended set inside it that its rest doesn't contain
            done = done.where("ended").select(F.col("x").alias("before"), F.col("item").alias("last"))
            grown = grown.join(done, (F.col("item") == F.col("last")) & (F.size(F.array_except("before", "x")) == 0), "left_anti")
        grown = grown.withColumn("is_rule", passes(F.col("n_bad"), F.col("n")))
        grown = cut(grown.withColumn("ended", (F.col("is_rule") | (F.col("n") == F.col("of"))) if least_only else F.lit(False)), "grown")
        rounds.append(grown)
        left = grown.where(~F.col("ended")).groupBy("x").agg(F.collect_list("item").alias("left"), F.max("n_bad").alias("most"))
        rows = front.join(left, "x").withColumn("tail", F.array_intersect("tail", "left"))
        stay = rows.groupBy("x", "most").agg(F.sum(F.when(F.size("tail") == F.size("left"), F.col("n") - F.col("n_bad")).otherwise(0)).alias("stay"))
        stay = stay.where(passes(F.col("most"), F.col("most") + F.col("stay"))).select("x")
        after = rows.join(stay, "x", "left_semi").select("x", "tail", "n", "n_bad", "n_long", F.posexplode("tail").alias("at", "item"))
        after = after.withColumn("tail", F.expr("slice(tail, at + 2, size(tail))")).where(F.size("tail") > 0)
        after = after.join(grown.select("x", "item", F.col("n").alias("of")), ["x", "item"])
        after = cut(after.groupBy(F.concat("x", F.array("item")).alias("x"), "of", "tail").agg(*sums), "front")
        discard(front)
        front = after
    discard(front)
    found = [g.where("is_rule").select(F.array_sort(F.concat("x", F.array("item"))).alias("items")) for g in rounds]
    return reduce(DataFrame.unionByName, found), rounds


def mine_rules(
    labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float, min_count: int, most_items: int = 12, least_only: bool = False
) -> DataFrame:
    """(rule, items, n, n_bad, confidence, lift, key) from rows (tokens, bad).

    items lists the tokens of each of the rule's items, rule joins them: ``|`` between
    the tokens of an item, a space between items. Of the labelled URLs n hold
    them all, n_bad of which are bad. key holds the tokens of the rarest item. With
    ``least_only`` rules that contain another one are left out: they fire nowhere
    else. ``most_items`` says which baskets FP-growth gets; the rules are the same for each value.
    """
    from pyspark.ml.fpm import FPGrowth

    baskets = cut(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("basket"), "tokens", F.coalesce("bad", F.lit(False)).alias("bad")), "baskets")
    n, n_bad = baskets.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    items = cut(_merged(baskets), "items")
    least = max(min_count, math.ceil(min_support * n), 1)
    confidence = lambda bad, seen: bad / seen
    lift = lambda bad, seen: confidence(bad, seen) * n / max(n_bad, 1)
    passes = lambda bad, seen: (bad >= least) & (confidence(bad, seen) >= min_confidence) & (lift(bad, seen) >= min_lift)
    # a rule with a token in fewer bad URLs than the support asks for has too little of it
    known = items.where(F.col("token") == F.col("item")).where((F.col("n_bad") >= least) & (F.col("n") < n)).select("item", "n", "n_bad")
    alone = passes(F.col("n_bad"), F.col("n"))  # least rules of one item, which no other least rule has
    held = baskets.select("basket", "bad", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token").select("basket", "bad", "item").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda i: i["item"])  # rare ones first
    ready = cut(held.join(known.where(~alone) if least_only else known, "item").groupBy("basket", "bad").agg(ordered.alias("tail")), "ready")
    is_long = F.size("tail") > most_items
    short = cut(ready.where(~is_long).select(F.when(F.col("bad"), F.concat("tail", F.array(F.lit(BAD)))).otherwise(F.col("tail")).alias("items")), "short")
    size = max(short.count(), 1)
    # support is counted over the baskets that have an item left
    model = FPGrowth(minSupport=min(1.0, (least - 0.5) / size), minConfidence=0.0).fit(short)
    frequent = cut(model.freqItemsets, "frequent")
    with_bad = F.array_contains("items", BAD)
    seen = frequent.where(~with_bad).select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    found = frequent.where(with_bad & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.col("freq").alias("n_bad"))
    # a rule that no long bad basket holds has all its bad baskets here; the good ones of the long baskets only lower it
    found = found.join(seen, "items").where(passes(F.col("n_bad"), F.col("n"))).select("items")
    if least_only:
        found = found.unionByName(known.where(alone).select(F.array("item").alias("items")))
    rounds: list[DataFrame] = []
    if not ready.where(is_long & F.col("bad")).isEmpty():
        front = ready.groupBy(F.expr("cast(array() AS array<string>)").alias("x"), F.lit(n).cast("long").alias("of"), "tail")
        front = cut(front.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.count_if(is_long & F.col("bad")).alias("n_long")), "front")
        grown, rounds = _grown(front, passes, least, least_only)
        found = found.unionByName(grown).distinct()
    found = cut(found.withColumn("rule", F.array_join("items", " ")), "itemsets")
    discard(short, ready, frequent, *rounds)
    rarest = found.select("rule", F.explode("items").alias("item")).join(known, "item").groupBy("rule").agg(F.min_by("item", F.struct("n", "item")).alias("key"))
    index = found.join(rarest, "rule")
    # exact counts over whole baskets, each distinct set of items once
    sets = held.groupBy("basket", "bad").agg(F.array_sort(F.collect_list("item")).alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
    hits = sets.select("held", "n", "n_bad", F.explode("held").alias("key")).join(index, "key").where(F.size(F.array_except("items", "held")) == 0)
    counted = hits.groupBy("rule", "items", "key").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    nb, k = F.col("n_bad"), F.col("n")
    good_rules = cut(counted.where(passes(nb, k)).withColumns({"confidence": confidence(nb, k), "lift": lift(nb, k)}), "rules")
    if least_only:
        inner = good_rules.select(F.col("rule").alias("inner"), F.col("items").alias("of"), "key")
        within = good_rules.select("rule", "items", F.explode("items").alias("key")).join(inner, "key")
        within = within.where((F.col("rule") != F.col("inner")) & (F.size(F.array_except("of", "items")) == 0)).select("rule").distinct()
        good_rules = cut(good_rules.join(within, "rule", "left_anti"), "least_rules")
    whole = items.where(F.col("token") == F.col("item")).select("item", "tokens")
    full = good_rules.select(F.col("rule").alias("of"), "key", F.explode("items").alias("item")).join(whole, "item")
    full = full.groupBy("of").agg(F.array_sort(F.collect_list("tokens")).alias("items"), F.max(F.when(F.col("item") == F.col("key"), F.col("tokens"))).alias("key"))
    name = F.array_join(F.transform("items", lambda i: F.array_join(i, "|")), " ")
    return good_rules.drop("items", "key").join(full, F.col("rule") == F.col("of")).select(name.alias("rule"), "items", "n", "n_bad", "confidence", "lift", "key")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules=STATED,
    min_support: float = 0.002,
    min_confidence: float = 0.6,
    min_lift: float = 1.5,
    min_count: int = 20,
    most_items: int = 12,
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of each row of ``pages``.

    ``labels`` (doc_id, quality, toxic) say by doc_id = page_id which
    pages are bad: quality 0 or toxic 1; null labels say nothing. The stated rule
    decides where one fits, the mined ones elsewhere; of several mined rules that
    fit and contain no other one, mined_rule names that of most confidence, then the greatest by name. A rule's support is
    ``min_support`` of the labelled pages and ``min_count`` of them at least. A null
    URL or one without ``://`` has an empty host and path and no stated rule. Rows
    stay as they are, repeated or not; an empty table gives none; extra columns
    are not read, whatever their names.
    """
    host, path = host_and_path()
    p = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumn("tokens", url_tokens())
    name, verdict = stated_rule(rules)
    p = p.withColumns({"rule": name, "stated": verdict, "set": F.array_join("tokens", " ")})
    bad = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    bad = bad.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    index = mine_rules(p.select("page_id", "tokens").join(bad, "page_id").select("tokens", "bad"), min_support, min_confidence, min_lift, min_count, most_items, least_only=True)
    sets = p.where(F.col("stated").isNull()).groupBy("set").agg(F.first("tokens").alias("held"))
    index = cut(index.withColumn("key", F.explode("key")), "index")
    hits = sets.select("set", "held", F.explode("held").alias("key")).join(index, "key").where(F.forall("items", lambda i: F.arrays_overlap(i, F.col("held"))))
    hits = hits.groupBy("set").agg(F.max_by("rule", F.struct("confidence", "rule")).alias("mined_rule"))
    hits = cut(hits, "hits")  # its size is known then, and a frequent set's partition can be split
    out = p.join(hits, "set", "left")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("stated", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule")
    )
