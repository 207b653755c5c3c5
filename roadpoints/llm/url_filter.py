"""URL filters: host and path rules, and a blocked Bloom filter of listed URLs before an exact join with the list.

Only DataFrame functions are used. The filter has a fixed number of blocks of 64 bits; all probes of a URL fall into one
block, so a look-up reads one element of one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.session import cut

#: blocks of the filter (64 bits each, 512 KiB in all, whatever the length of the list) and probes within a block
BLOCKS, PROBES = 1 << 16, 6
#: (rule, verdict); a rule is a host and, from its first slash on, the beginning of a path
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: host words whose URLs the query's list holds, standing for an external list
LISTED_WORDS = ("spam", "cheap", "pills", "casino", "malware")


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without leading www. or m., path without index page, .html and trailing slashes; no scheme, query or fragment."""
    bare = F.regexp_replace(host, r"^(?:www\.|m\.)+", "")
    return F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"(?:/index)?\.html?$", ""), r"/+$", ""))


def _matches(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule with its verdict, or null. The rules are few and stand in the plan."""
    fits = []
    for rule, verdict in rules:
        host, path = rule.split("/", 1)
        on = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits.append(F.when(on & F.col("path").startswith("/" + path),
                           F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def _probe(url: Column) -> tuple[Column, Column]:
    """(block, mask) of a URL: 16 bits of its hash choose the block, six bits each the PROBES bits of the mask."""
    h, g = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    bits = [F.shiftright(g, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(PROBES)]
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits[0])
    for b in bits[1:]:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))
    return F.pmod(h, F.lit(BLOCKS)).cast("int"), mask


def bloom(listed: DataFrame) -> DataFrame:
    """One row with the filter of ``listed`` (url) as an array of BLOCKS longs."""
    block, mask = _probe(F.col("url"))
    words = listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))
    blank = listed.sparkSession.range(0, BLOCKS, 1, 1).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("mask"))
    every = words.unionByName(blank).groupBy("block").agg(F.bit_or("mask").alias("mask"))  # at most BLOCKS rows from here on
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "mask"))), lambda s: s["mask"]).alias("filter"))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of ``pages`` (page_id, url; other columns are ignored), one row per row.

    The longest rule that fits decides; where none fits, a URL is blocked if its canonical form is in ``listed`` (url, canonical)
    and allowed otherwise. A null or malformed URL has an empty host and path, no rule, and is allowed.

    Only possible hits of the filter are shuffled to the join with the list; all other rows pass through in place.
    """
    listed = cut(listed.where("url is not null").select("url").distinct())
    p = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.select("page_id", "host", "path", _matches(rules).alias("m"), F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))).alias("canonical"))
    block, mask = _probe(F.col("canonical"))
    filt = bloom(listed).scalar()
    word = F.element_at(filt, block + 1)
    p = p.withColumn("mask", mask)
    maybe = F.coalesce((word.bitwiseAND(F.col("mask")) == F.col("mask")) & F.col("canonical").isNotNull(), F.lit(False))
    p = p.withColumn("maybe", maybe).drop("mask")
    hits = p.where("maybe").join(listed.select(F.col("url").alias("canonical"), F.lit(True).alias("on")), "canonical", "left")
    rest = p.where("not maybe").withColumn("on", F.lit(None).cast("boolean"))
    cols = ["page_id", "host", "path", F.col("m.rule").alias("rule"),
            F.coalesce("m.verdict", F.when(F.col("on"), "block").otherwise("allow")).alias("verdict"), F.coalesce("on", F.lit(False)).alias("listed")]
    return hits.select(*cols).unionByName(rest.select(*cols))


def listed_urls(pages: DataFrame, words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """(url): the distinct canonical URLs of ``pages`` whose host holds a listed word, as a stand-in for an external list."""
    p = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where(F.col("host").rlike("|".join(words)))
    return p.select(canonical(F.col("host"), F.col("path")).alias("url")).distinct()


_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
with p as (select page_id, {_HOST} host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
c as (select *, regexp_replace(host, '^(?:www\.|m\.)+', '') || regexp_replace(regexp_replace(path, '(?:/index)?\.html?$', ''), '/+$', '') canonical from p),
r(host, path, rule, verdict) as (values {", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for r, v in RULES)}),
f as (select page_id, max_by(r.rule, length(r.rule)) rule, max_by(r.verdict, length(r.rule)) verdict from c join r
      on (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path) group by page_id),
l as (select distinct canonical from c where regexp_matches(host, '{"|".join(LISTED_WORDS)}'))
select c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, case when l.canonical is not null then 'block' else 'allow' end) verdict, l.canonical is not null listed
from c left join f using (page_id) left join l using (canonical)"""


@query("op8_url_filter", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, listed_urls(pages))
