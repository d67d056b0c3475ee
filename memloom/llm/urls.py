"""URL filters: host and path rules, and a character model where none fits.

Two variable-order Markov models, of accepted and of rejected URLs, are made
from the URLs that the rules decide.  They read the whole URL, character by
character as it is written.  A character's probability given the ``ORDER``
before it is its count there, smoothed by the estimate one order down with a
weight that falls as the context's count grows; a context that was never seen
leaves all to the shorter one.  What is counted are windows of ``ORDER`` + 1
characters, a table that grows with the URLs.  The log ratio of the two models
is worked out once for each distinct window, order by order from the table's
own suffixes, and joined to the windows of the distinct URLs.  A URL's score
is the mean over its characters, and the threshold is set on held-out URLs: of
those below it, nineteen in twenty are rejected ones.  Only DataFrame
functions are used."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import discard, durable, fresh

#: Characters before one that its probability may depend on.
ORDER = 5
#: Before a URL's first character and after its last.
_BEFORE, _AFTER = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path as in ``example.org/en/``; ``allow`` its verdict."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        a, slash, b = self.text.partition("/")
        return slash + b


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The text of the longest rule that fits the host or a parent of it and starts the path; null if none does.
    Of rules of one length the first by text counts."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def windows(s: Column) -> Column:
    """Each character and the end, with the ``ORDER`` characters before it."""
    # split into characters once: places in a text of bytes of unlike length are found by walking from its start
    marks = F.concat(F.array(*[F.lit(_BEFORE)] * ORDER), F.filter(F.split(s, ""), lambda c: c != ""), F.array(F.lit(_AFTER)))
    out = F.slice(marks, F.lit(1), F.size(marks) - ORDER)
    for k in range(2, ORDER + 2):
        out = F.zip_with(out, F.slice(marks, F.lit(k), F.size(marks) - ORDER), lambda x, y: F.concat(x, y))
    return out


def log_ratios(counts: DataFrame, strength: float) -> DataFrame:
    """(w, ratio) for every window of ``counts`` (w, yes, no; a row each): log P(accepted) - log P(rejected) of its last
    character.  At each order P = (count + strength * P one order down) / (count of the context + strength),
    and one in the number of known characters below the lowest."""
    names = ("yes", "no")
    # the larger class counts as if it were as small as the other: else what neither has seen would look rejected
    total = counts.agg(*[F.sum(n).cast("double").alias(n) for n in names]).first()
    least = min(total[n] or 0.0 for n in names)
    scale = {n: least / total[n] if total[n] else 0.0 for n in names}
    below = None
    for order in range(ORDER + 1):
        own = counts.groupBy(F.right("w", F.lit(order + 1)).alias("gram")).agg(*[(F.sum(n) * F.lit(scale[n])).alias(n) for n in names])
        own = own.withColumn("context", F.left("gram", F.lit(order)))
        # a context has a row for each character that follows it
        context = own.groupBy("context").agg(*[F.sum(n).alias(f"all_{n}") for n in names])
        now = own.join(context, "context").drop("context")
        if below is None:
            known = own.count() + 1
            now = now.withColumns({f"q_{n}": F.lit(1.0 / known) for n in names})
        else:
            now = now.withColumn("suffix", F.right("gram", F.lit(order))).join(below, "suffix").drop("suffix")
        p = [((F.col(n) + strength * F.col(f"q_{n}")) / (F.col(f"all_{n}") + strength)).alias(f"q_{n}") for n in names]
        below = now.select(F.col("gram").alias("suffix"), *p)
    return below.select(F.col("suffix").alias("w"), (F.log("q_yes") - F.log("q_no")).alias("ratio"))


def judged(pages: DataFrame, rules: Sequence[Rule], strength: float = 2.0, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block).

    A rule decides where one fits, else the models do: block if the score is
    below the threshold.  They learn from all URLs that rules decide but those
    with crc32 modulo 4 of 0, which set the threshold.  Where no score
    parts rejected from accepted URLs all others are allowed.  A URL without
    ``://`` has an empty host and path and is scored like any other; a null
    URL is scored as an empty string.  Repeated rows count each; all columns stay (``host`` and
    the like replace columns of those names); an empty table gives no rows."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    known = pages.select(url.alias("url")).groupBy("url").agg(F.count(F.lit(1)).alias("times"))
    known = known.withColumn("rule", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules))
    allowed = F.col("rule").isin([r.text for r in rules if r.allow])
    known = known.select("url", "times", F.when(F.col("rule").isNotNull(), allowed).alias("yes"), (F.crc32("url") % 4 == 0).alias("held"))
    # numbered when written: a number goes with each window, not the URL
    known = durable(known.withColumn("number", F.monotonically_increasing_id()), "urls")
    # dealt by count, not bytes: the windows made of each URL are many times its size
    dealt = known.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "number")
    spot = dealt.select("number", "times", F.when(~F.col("held"), F.col("yes")).alias("learn"), F.explode(windows(F.col("url"))).alias("w"))
    count = lambda of: F.sum(F.when(of, F.col("times")).otherwise(0))
    counts = durable(spot.groupBy("w").agg(count(F.col("learn")).alias("yes"), count(~F.col("learn")).alias("no")), "url-windows")
    ratios = durable(log_ratios(counts, strength), "url-ratios")
    means = spot.select("number", "w").join(ratios, "w").groupBy("number").agg(F.avg("ratio").alias("score"))
    scores = durable(known.join(means, "number").select("url", "times", "yes", "held", "score"), "url-scores")
    discard(known, counts, ratios)
    cut = threshold(scores.where("held and yes is not null"))
    key, value = fresh("__url", pages.columns), fresh("__score", pages.columns)
    own = scores.select(F.col("url").alias(key), F.col("score").alias(value))
    out = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).drop("score")
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    out = out.join(own, F.coalesce(F.col(url_col), F.lit("")) == F.col(key)).drop(key).withColumnRenamed(value, "score")
    method = F.when(F.col("score") < F.lit(cut), "block").otherwise("allow") if cut is not None else F.lit("allow")
    by_rule = F.when(F.col("rule").isin([r.text for r in rules if r.allow]), "allow").otherwise("block")
    return out.withColumn("verdict", F.when(F.col("rule").isNull(), method).otherwise(by_rule))


def threshold(scored: DataFrame, precision: float = 0.95, step: float = 0.01, reach: int = 2000) -> float | None:
    """The highest score below which at least ``precision`` of the URLs are rejected ones,
    and 0 at most, where both models hold a URL alike likely.  ``scored`` has yes, score and times.

    Scores are counted by steps of ``step`` up to ``reach`` either way, so the
    table that is summed up has at most 2 * ``reach`` + 1 rows; one number
    reaches the driver.  None if there is no such score."""
    at = F.greatest(F.least(F.floor(F.col("score") / step), F.lit(reach)), F.lit(-reach))
    count = lambda of: F.sum(F.when(of, F.col("times")).otherwise(0))
    bins = scored.groupBy(at.alias("b")).agg(count(F.col("yes")).alias("yes"), count(~F.col("yes")).alias("no"))
    below = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.select("b", F.sum("yes").over(below).alias("low_yes"), F.sum("no").over(below).alias("low_no"))
    best = bins.where((F.col("low_no") > 0) & (F.col("low_no") >= precision * (F.col("low_yes") + F.col("low_no")))).agg(F.max("b") + 1).first()[0]
    return None if best is None else min(0.0, best * step)
