"""Mix sources to target weights, by words.

Every document gets a hash-random key.  Per source, the documents are sorted by key
in ranges of the key (of about equal size, as many as the source needs), and the
running sum of their words is put together from sums per range.  A source's budget
is met exactly: whole epochs of all its documents, then the documents in key order
up to the word where the budget ends.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesmend.llm.common import WORD, fresh, quoted, text_of
from seriesmend.plans.staging import stage

ROWS_PER_RANGE = 4_000     # documents sorted by one task at a time
RANGES_PER_GROUP = 10_000  # ranges summed by one task at a time
WEIGHTS = (5, 2, 1)        # of the sources in code point order, repeating
SHARE = 1.5                # all targets together, of all words
MOST_EPOCHS = 2


def words_in(text: str = "text") -> Column:
    """The number of words of a text (null: 0)."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def random_key(doc_id: str) -> Column:
    """A hash of the doc_id as 32 hexadecimal digits; equal in every run."""
    return F.md5(F.coalesce(quoted(doc_id).cast("string"), F.lit("")))


def targets(sources: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS,
            most: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (source, rows, source_size) with ``place`` and ``target`` (double).

    A target is the source's weight times one level, at most ``most`` times its size;
    what is cut off raises the level of the others.  Sorted by the level at which
    they are full, sources fill up one after another: the level is that of the first
    one that doesn't.  The table has one row per source; null sorts last.
    """
    code_points = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sources.withColumn("place", F.row_number().over(code_points))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sized = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    level = (total * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = sized.withColumn("level", level).withColumn("rank", F.row_number().over(by_level))
    full = F.col("cap") <= F.col("level") * F.col("weight")
    water = levels.filter(~full).agg(F.min_by("level", "rank").alias("water"))
    return levels.crossJoin(F.broadcast(water)).select(  # one row
        "source", "place", "rows", "source_size",
        F.when(full, F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, into: str, size: Column, doc_id: str = "doc_id", source: str = "source",
        ties: tuple = (), share: float = SHARE, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Add a struct ``into``: size, source_size, target, taken (words the mix takes).

    ``ties`` are columns that order documents whose doc_ids are equal or null; rows
    equal in all of them are interchangeable.  A document without words takes
    nothing.  An empty table gives an empty one.
    """
    totals = docs.select(quoted(source).alias("source"), size.alias("size")).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    per_source = targets(totals, share, weights, most)
    n, key, got, named = (fresh(docs, c) for c in ("size_", "key_", "of_", "source_"))
    per_source = per_source.select(F.col("source").alias(named), F.struct(
        "place", "source_size", "target", F.ceil(F.col("rows") / ROWS_PER_RANGE).cast("long").alias("ranges"),
    ).alias(got))
    rows = (
        docs.withColumns({n: size, key: random_key(doc_id)})
        .join(per_source, quoted(source).eqNullSafe(quoted(named))).drop(named)
    )
    place, ranges = quoted(got)["place"], quoted(got)["ranges"]
    part = fresh(docs, "range_")
    at = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    rows = rows.withColumn(part, F.shiftright(at * ranges, 32))

    # the sum of all ranges before one: of the groups of ranges before its own, and within its own
    sums = rows.groupBy(place.alias("place"), quoted(part).alias("range")).agg(F.sum(n).alias("words"))
    sums = sums.withColumn("group", F.floor(F.col("range") / RANGES_PER_GROUP))
    groups = sums.groupBy("place", "group").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("place").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("place", "group", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("place", "group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("inner", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(
        groups, ["place", "group"]).select(
        F.col("place").alias(p := fresh(rows, "at_place")), F.col("range").alias(r := fresh(rows, "at_range")),
        (F.col("start") + F.col("inner")).alias(start := fresh(rows, "start_")))

    order = [quoted(key), quoted(doc_id).asc_nulls_last(), quoted(n), *[quoted(c).asc_nulls_last() for c in ties]]
    running = Window.partitionBy(place, quoted(part)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = fresh(rows, "before_")
    summed = rows.withColumn(before, F.coalesce(F.sum(n).over(running), F.lit(0)))
    summed = summed.join(starts, (place == quoted(p)) & (quoted(part) == quoted(r)))
    words, target, whole = quoted(n), quoted(got)["target"], quoted(got)["source_size"]
    epochs = F.when(whole > 0, F.floor(target / whole)).otherwise(F.lit(0)).cast("long")
    rest = F.floor(target - epochs * whole).cast("long")
    last = F.greatest(F.least(words, rest - quoted(start) - quoted(before)), F.lit(0))
    return summed.withColumn(into, F.struct(
        words.alias("size"), whole.alias("source_size"), target.alias("target"),
        (epochs * words + last).alias("taken"),
    )).select(*[quoted(c) for c in docs.columns], quoted(into))


def taken_documents(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The documents as often as the mix takes them (see ``copies``), with their own columns.

    Only narrow rows are sorted and summed.  The texts meet them afterwards by their place
    in the files that ``docs`` is read from; other frames are written first.
    """
    if not _has_places(docs):
        docs = stage(docs)
    place, tie, size, into = (fresh(docs, c) for c in ("place_", "tie_", "words_", "mix_"))
    placed = docs.withColumn(place, F.struct("_metadata.file_path", "_metadata.row_index"))
    keys = [c for c in (settings.get("doc_id", "doc_id"), settings.get("source", "source"))]
    narrow = placed.select(place, *[quoted(c) for c in keys], words_in(text).alias(size), F.xxhash64(quoted(text)).alias(tie))
    mixed = mix(stage(narrow), into, quoted(size), ties=(tie,), **settings)
    wanted = mixed.filter(quoted(into)["taken"] > 0).select(place, into)
    return copies(placed.join(wanted, place).drop(place), into, text).select(*[quoted(c) for c in docs.columns])


def _has_places(docs: DataFrame) -> bool:
    try:
        docs.select("_metadata.row_index").schema
    except AnalysisException:
        return False
    return True


def copies(mixed: DataFrame, into: str, text: str = "text") -> DataFrame:
    """One row per epoch in which a document is taken, without the struct ``into``.

    A budget that ends inside a document cuts its last copy after the word where it
    ends; the words before keep their white space.
    """
    taken, size = quoted(into)["taken"], quoted(into)["size"]
    epoch = fresh(mixed, "epoch_")
    repeated = mixed.filter(taken > 0).withColumn(
        epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(taken / size).cast("long") - 1)))
    left = taken - quoted(epoch) * size
    spaced = F.regexp_extract_all(quoted(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(left < size, F.array_join(F.slice(spaced, F.lit(1), left.cast("int")), "")).otherwise(quoted(text))
    return repeated.withColumn(text, cut).drop(into, epoch)
