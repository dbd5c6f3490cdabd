"""URL filters: rules by host and path, and a list of canonical URLs behind a Bloom filter.

The list is kept as a blocked Bloom filter: a URL's first hash picks a block of 512
bits, its second hash one bit in each of the block's eight longs.  What the filter
lets pass may be listed; an exact join with the list removes the false hits.  All of
it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.llm.common import fresh, lower_ascii, quoted, text_of
from seriesmend.plans.staging import stage

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BITS_PER_URL = 16           # about one false hit in a thousand
BLOCK_BITS = 512
FILTER_BYTES = 32 << 20     # a larger filter is joined block by block instead of broadcast
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without a last slash, sorted query.

    The scheme, the fragment and tracking parameters are left out.
    """
    rest = _after_scheme(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?)?/*$", "")
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (or null), and its verdict.

    A rule ``host/path`` fits its host and all subdomains, if the path starts with
    its own.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """One bit for each long of a block, from six bits of the second hash each."""
    spread = F.xxhash64(url, F.lit(1))
    places = [F.shiftrightunsigned(spread, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(8)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]


def bloom_filter(listed: DataFrame, urls: int) -> tuple[DataFrame, int]:
    """``listed`` (url) as rows (block, w0 .. w7), and the number of blocks."""
    blocks = max(1, math.ceil(urls * BITS_PER_URL / BLOCK_BITS))
    ones = [b.alias(f"b{j}") for j, b in enumerate(_bits(F.col("url")))]
    rows = listed.select(_block(F.col("url"), blocks).alias("block"), *ones)
    return rows.groupBy("block").agg(*[F.bit_or(f"b{j}").alias(f"w{j}") for j in range(8)]), blocks


def listed_urls(urls: DataFrame) -> DataFrame:
    """The distinct canonical URLs of a column ``url``, written once; null is no URL."""
    return stage(urls.filter("url IS NOT NULL").select(canonical(F.col("url")).alias("url")).distinct())


def mark_listed(rows: DataFrame, url: str, listed: DataFrame, into: str) -> DataFrame:
    """Add boolean ``into``: the canonical form of the url is in ``listed`` (url).

    A null url is not listed.  Rows and other columns are kept as they are.
    """
    count = listed.count()
    table, blocks = bloom_filter(listed, count)
    if blocks * BLOCK_BITS // 8 <= FILTER_BYTES:
        table = F.broadcast(table)
    form, block = fresh(rows, "canonical_"), fresh(rows, "block_")
    words = [fresh(rows, f"w{j}_") for j in range(8)]
    table = table.toDF(block, *words)
    keyed = rows.withColumn(form, canonical(text_of(url)))
    probed = keyed.join(table, _block(quoted(form), blocks) == quoted(block), "left")
    passes = quoted(url).isNotNull() & quoted(block).isNotNull()
    for word, bit in zip(words, _bits(quoted(form))):
        passes = passes & (quoted(word).bitwiseAND(bit) != 0)
    passes = F.coalesce(passes, F.lit(False))
    keep = [quoted(c) for c in rows.columns]
    misses = probed.filter(~passes).select(*keep, F.lit(False).alias(into))
    hits = probed.filter(passes).select(*keep, quoted(form))
    exact = listed.select(F.col("url").alias(known := fresh(hits, "known_")))
    hits = hits.join(exact, quoted(form) == quoted(known), "left")
    return misses.unionAll(hits.select(*keep, quoted(known).isNotNull().alias(into)))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    The longest rule decides; without one, a page is blocked if its URL is listed.
    Host and path of a null url or one without ``://`` are empty.
    """
    marked = mark_listed(pages, url, listed, hit := fresh(pages, "listed_"))
    host, path = host_of(text_of(url)), path_of(text_of(url))
    rule, verdict = rule_for(host, path, rules)
    own = F.when(quoted(hit), F.lit("block")).otherwise(F.lit("allow"))
    kept = [quoted(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return marked.select(
        *kept, host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
