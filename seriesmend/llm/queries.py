"""The registered queries of the numbered operators, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesmend.llm import (
    audit, chat, cuckoo, extraction, gru, minhash, mixing, negatives, pieces, quality, substrings, urls, warc,
)
from seriesmend.llm.common import read
from seriesmend.plans.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The columns a query needs, whatever else the table holds."""
    return read(spark, folder, "documents").select(*columns)


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_SQL = rf"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL} AS words FROM documents
), runs AS (
  SELECT doc_id, i, words[i:i + 7] AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT s.doc_id, source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id LEFT JOIN lines l ON s.doc_id = l.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS docs, sum(base_failed::INT) AS failures FROM judged GROUP BY source
), moments AS (
  SELECT avg(failures / docs) AS mean, var_samp(failures / docs) AS spread,
    avg(1 / docs) AS inverse, sum(docs)::DOUBLE AS all_docs FROM hosts
), fitted AS (
  SELECT *, (spread - mean * (1 - mean) * inverse) / (1 - inverse) AS own FROM moments
), prior AS (
  SELECT mean, CASE WHEN inverse < 1 AND own > 0 AND mean * (1 - mean) > 0
    THEN greatest(least(mean * (1 - mean) / own - 1, all_docs), 0) ELSE all_docs END AS weight
  FROM fitted
), condemned AS (
  SELECT source, (failures + mean * weight) / (docs + weight) > 0.5 AS host_failed
  FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_failed AS kept
FROM judged j JOIN condemned c ON j.source IS NOT DISTINCT FROM c.source
"""


@query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "source", "text")
    # counted per host and joined back: written once, without the texts
    judged = stage(quality.features(docs, "q").select("doc_id", "source", "q.*"))
    failed = F.col("base_failed")
    hosts = quality.host_verdicts(judged, "source", failed)
    return quality.judge(judged, hosts, "source", failed, "kept").drop("source")


COPIES_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER best = 1 AS kept, text_sha256
FROM rows
WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


@query("op8_exact_dedup", COPIES_SQL)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cuckoo.groups(documents(spark, folder, "doc_id", "text")).withColumnRenamed(
        "digest", "text_sha256"
    )


@query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.label(documents(spark, folder, "doc_id", "text"))


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM docs GROUP BY source
), sized AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap
  FROM sources
), levels AS (
  SELECT *, row_number() OVER by_level AS rank,
    (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (by_level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM sized WINDOW by_level AS (ORDER BY cap / weight, place)
), filled AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap::DOUBLE
    ELSE (SELECT min_by(level, rank) FROM levels WHERE cap > level * weight) * weight END AS target
  FROM levels
), running AS (
  SELECT doc_id, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY key, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs
  FROM docs JOIN filled ON docs.source IS NOT DISTINCT FROM filled.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(least(size, floor(target - epochs * source_size)::BIGINT - before), 0))::BIGINT AS taken
FROM running
"""


@query("op1_source_mixing", MIX_SQL)
def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    # read three times (per source, per range, per document): written once, without the texts
    rows = stage(documents(spark, folder, "doc_id", "source", "text").select(
        "doc_id", "source", mixing.words_in().alias("words"), F.xxhash64("text").alias("text_hash")))
    mixed = mixing.mix(rows, "mix", F.col("words"), ties=("text_hash",))
    return mixed.select("doc_id", "mix.*")


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids, and whether decoding them gives its text back."""
    encoded = pieces.encode_checked(documents(spark, folder, "doc_id", "text"))
    return encoded.select("doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip")


@query("op4_chat_format")
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair(read(spark, folder, "conversations"))


# the list of the query: the pages of hosts with one of these words in their name
LISTED_WORDS = ("casino", "pills", "viagra", "porn", "poker", "loans")
LISTED_HOST = "(^|[.-])(" + "|".join(LISTED_WORDS) + ")([.-]|$)"

URLS_SQL = rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM cut
), forms AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept,
    regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '(/index\.html?)?/*$', '') AS place FROM parts
), canonical AS (
  SELECT *, place || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS form FROM forms
), listed AS (
  SELECT DISTINCT form FROM canonical WHERE url IS NOT NULL AND regexp_matches(host, '{LISTED_HOST}')
), fits AS (
  SELECT c.*, l.form IS NOT NULL AND url IS NOT NULL AS hit,
    (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' AS net,
    (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' AS net_en,
    (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' AS com_de,
    (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' AS org_fr
  FROM canonical c LEFT JOIN listed l ON c.form = l.form
)
SELECT page_id, host, path,
  CASE WHEN net_en THEN 'example.net/en/' WHEN com_de THEN 'example.com/de/' WHEN org_fr THEN 'org/fr/' WHEN net THEN 'net/' END AS rule,
  CASE WHEN net_en OR (org_fr AND NOT com_de) THEN 'allow' WHEN com_de OR net OR hit THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""


@query("op6_url_filter", URLS_SQL)
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url")
    bad = pages.filter(urls.host_of(F.col("url")).rlike(LISTED_HOST))
    judged = urls.judge(pages, urls.listed_urls(bad))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_warc_derivatives")
def op10_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses(read(spark, folder, "pages")))


@query("op9_recurrent_scores")
def op9_recurrent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return gru.log_likelihoods(documents(spark, folder, "doc_id", "text"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove(documents(spark, folder, "doc_id", "text"), digests=True)


NEGATIVES_SQL = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM valid a JOIN valid b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=moved)


AUDIT_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS_SQL} AS words FROM documents
), failing AS (
  SELECT doc_id, part,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM docs
), known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM failing f LEFT JOIN known k ON f.doc_id = k.doc_id GROUP BY ALL
), names AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM names a, names b, names c, names d, names e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, s::INT AS step, filter_order[s:s] AS name, filter_order[1:s - 1] AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS s)
), outcomes AS (
  SELECT part, filter_order, step, name, n, good, toxic, fails,
    contains(fails, name) AS failing,
    length(translate(earlier, fails, '')) < length(earlier) AS gone
  FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, name,
    sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = name THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM outcomes GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley
FROM summed
"""


@query("op13_filter_audit", AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    labels = read(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return audit.audit(documents(spark, folder, "doc_id", "text", "source"), labels)


# The pages of the given tables mark their text by one article element of h1, p, b and br, and
# escape &, <, >, " and ' only; for those, SQL can state the text.
ARTICLE_SQL = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), parts AS (
  SELECT page_id, url, list_transform(
    string_split_regex(regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(?:p|h1)>'),
    lambda t: trim(regexp_replace(
      regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)),
        '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS texts
  FROM articles
)
SELECT page_id, url, array_to_string(list_filter(texts, lambda t: t <> ''), chr(10)) AS text,
  length(array_to_string(list_filter(texts, lambda t: t <> ''), chr(10)))::BIGINT AS n_chars
FROM parts
"""


@query("op11_html_extraction", ARTICLE_SQL)
def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(read(spark, folder, "pages").select("page_id", "url", "html"))
