"""Quality rules of documents, and of the hosts they come from.

Every document is judged by rules on its own text.  The failures are then counted
per host; a host's failure rate is shrunk towards the rate of all hosts with a
beta prior that is fitted to the hosts themselves, so that a host with few
documents is not condemned by them.  Documents of a condemned host are rejected
together with those that failed on their own.

All of it is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.functions.binding import let
from seriesmend.llm.common import WORD, fresh, quoted, text_of, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """``least_words`` and ``most_repeated`` (percent of the words) judge a document,
    ``most_failed`` (a rate) a host."""

    least_words: int = 20
    most_repeated: int = 30
    window: int = 8
    most_failed: float = 0.5


def repeated_words(words: Column, window: int) -> Column:
    """How many words lie in a run of ``window`` words found twice or more in the text.

    Runs are told apart by a 64-bit hash of their words.  A text without an equal
    pair of half runs has no equal runs either, which settles most texts.  For the
    rest, sorting (hash, place) puts equal runs side by side; the covered words are
    the union of [place, place + window).
    """
    if window % 2:
        raise ValueError("the window must be even")
    half = window // 2

    def first(array: Column, n: Column) -> Column:
        return F.slice(array, F.lit(1), F.greatest(n, F.lit(0)))

    def half_runs(h: Column) -> Column:
        follow = [lambda i, j=j: F.get(h, i + j) for j in range(1, half)]
        return F.transform(
            first(h, F.size(h) - (half - 1)), lambda x, i: F.xxhash64(x, *[f(i) for f in follow])
        )

    def runs(q: Column) -> Column:
        return F.sort_array(F.transform(
            first(q, F.size(q) - half),
            lambda x, i: F.struct(F.xxhash64(x, F.get(q, i + half)).alias("h"), i.alias("i")),
        ))

    def places(r: Column) -> Column:
        again = F.transform(r, lambda x, i: F.when(
            (x["h"] == F.get(r, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(r, i - 1)["h"])), x["i"]
        ))
        return F.sort_array(F.array_compact(again))

    def covered(p: Column) -> Column:
        reach = F.transform(
            p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))
        )
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, half_runs), lambda q: F.when(
        F.size(q) > F.size(F.array_distinct(q)), let(let(runs(q), places), covered)
    ).otherwise(F.lit(0)))


def features(docs: DataFrame, into: str, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Add a struct ``into``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (all long) and base_failed.

    A null or empty text has no words and fails.  Other columns are kept as they are.
    """
    whole = text_of(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))

    def all_of(words: Column) -> Column:
        n_words = F.size(words).cast("long")
        return let(repeated_words(words, rules.window).cast("long"), lambda repeats: F.struct(
            n_words.alias("n_words"),
            F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.regexp_replace(whole, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
            ((n_words < rules.least_words) | (100 * repeats > rules.most_repeated * n_words)).alias("base_failed"),
        ))

    judged = let(words_of(whole), all_of)
    # unfolding a one-element array keeps later filters from repeating the expression
    return docs.select("*", F.inline(F.array(F.struct(judged.alias(into)))))


def host_verdicts(judged: DataFrame, host: str, failed: Column, rules: Rules = Rules()) -> DataFrame:
    """One row per host: host, docs, failures, rate (shrunk), host_failed.

    The prior beta(a, b) has the mean of the hosts' rates and, where they differ more
    than chance would make them, their spread (method of moments; every host counts
    once).  If they don't, or there is only one host, the prior weighs as much as
    all documents and every host has the common rate.  A null host is a host of
    its own.
    """
    counts = judged.groupBy(quoted(host).alias("host")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(failed.cast("long")).alias("failures")
    )
    rate = F.col("failures") / F.col("docs")
    moments = counts.agg(
        F.avg(rate).alias("mean"),
        F.var_samp(rate).alias("spread"),
        F.avg(1 / F.col("docs")).alias("inverse"),
        F.sum("docs").cast("double").alias("all_docs"),
    )
    chance = F.col("mean") * (1 - F.col("mean"))
    # var(rate) = chance * inverse + (1 - inverse) * chance / (weight + 1)
    own = (F.col("spread") - chance * F.col("inverse")) / (1 - F.col("inverse"))
    weight = F.when(
        (F.col("inverse") < 1) & (own > 0) & (chance > 0),
        F.greatest(F.least(chance / own - 1, F.col("all_docs")), F.lit(0.0)),
    ).otherwise(F.col("all_docs"))
    prior = moments.select("mean", weight.alias("weight"))
    shrunk = (F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("docs") + F.col("weight"))
    return (
        counts.crossJoin(F.broadcast(prior))  # the prior is one row
        .select("host", "docs", "failures", shrunk.alias("rate"))
        .withColumn("host_failed", F.col("rate") > rules.most_failed)
    )


def judge(judged: DataFrame, hosts: DataFrame, host: str, failed: Column, into: str) -> DataFrame:
    """Add boolean ``into``: the document passed and its host isn't condemned."""
    condemned = hosts.filter("host_failed").select(F.col("host").alias(name := fresh(judged, "host_no")),
                                                   F.lit(True).alias(mark := fresh(judged, "host_hit")))
    joined = judged.join(condemned, quoted(host).eqNullSafe(quoted(name)), "left")
    kept = ~failed & quoted(mark).isNull()
    return joined.withColumn(into, kept).drop(name, mark)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their own columns.

    The texts are judged twice (once to count, once to filter) rather than written
    in between; only counts per host are shuffled.  An empty table gives an empty
    table.
    """
    into, kept = fresh(docs, "quality"), fresh(docs, "kept")
    judged = features(docs, into, text, rules)
    failed = F.col(f"{into}.base_failed")
    narrow = judged.select(quoted(host).alias("host_"), failed.alias("failed_"))
    hosts = host_verdicts(narrow, "host_", F.col("failed_"), rules)
    marked = judge(judged, hosts, host, failed, kept)
    return marked.filter(quoted(kept)).select(*[quoted(c) for c in docs.columns])
