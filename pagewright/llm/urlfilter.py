"""URL filter: a blocked Bloom filter in front of an exact hash join.

The filter's blocks of eight 32-bit words are a small table that is joined to
every page by block number; a page whose eight bits are all set goes on to the
exact join with the listed canonical URLs, which removes false positives.
Everything is built-in expressions, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.cut import cut

WORDS = 8
BITS_PER_URL = 16
#: Bytes of blocks up to which the filter is broadcast; a larger one is joined by shuffle.
MAX_FILTER_BYTES = 64 << 20
#: Query parameters that say where a visitor came from, not what the page is.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)"


def canonical(url: Column) -> Column:
    """One spelling of a page's address.

    No scheme, user, ``www.``, default port, fragment, tracking parameters or
    trailing slash; host in lower case; parameters sorted. Null stays null;
    a blank URL is the empty string.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#[\s\S]*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?([\s\S]*)$", 1)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "(=|$)"))
    joined = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _mask(key: Column, word: int) -> Column:
    bit = F.shiftright(F.xxhash64(key, F.lit(1)), 5 * word).bitwiseAND(F.lit(31).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1), bit)


def _filter(keys: DataFrame, blocks: int) -> DataFrame:
    k = F.col("_key")
    masks = keys.select(_block(k, blocks).alias("_block"), *[_mask(k, i).alias(f"_w{i}") for i in range(WORDS)])
    return masks.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def url_filter(pages: DataFrame, listed: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``page_id, url, canonical_url, listed`` for every row of pages.

    ``listed`` has a column ``url``; it is made canonical as well, and nulls,
    blanks and repetitions in it don't matter. A page with a null or blank URL
    is not listed. Repeated pages come out repeated; other columns are dropped;
    an empty list lists nothing, and an empty table gives no rows.
    """
    keys = cut(listed.select(canonical(F.col("url")).alias("_key")).where("_key <> ''").distinct())
    n = keys.count()
    rows = pages.select("page_id", "url", canonical(F.col("url")).alias("canonical_url"))
    if n == 0:
        return rows.withColumn("listed", F.lit(False))
    blocks = max(1, -(-n * BITS_PER_URL // (32 * WORDS)))
    table = _filter(keys, blocks)
    if blocks * (4 * WORDS + 8) <= max_filter_bytes:
        table = F.broadcast(table)  # its bytes are checked
    k = F.col("canonical_url")
    tested = rows.withColumn("_at", _block(k, blocks)).join(table, F.col("_at") == F.col("_block"), "left")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(_mask(k, i)) == _mask(k, i))
    hit = F.coalesce(hit & k.isNotNull(), F.lit(False))
    tested = tested.select("page_id", "url", "canonical_url", hit.alias("_hit"))
    clear = tested.where(~F.col("_hit")).drop("_hit").withColumn("listed", F.lit(False))
    exact = tested.where("_hit").drop("_hit").join(keys, F.col("canonical_url") == F.col("_key"), "left")
    return clear.unionByName(exact.select("page_id", "url", "canonical_url", F.col("_key").isNotNull().alias("listed")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, and whether its address is on the list.

    The list is that of addresses seen in syndication feeds or on hosts known for spam.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where("url rlike 'utm_source=feed' or url rlike '(spam-farm|cheap-pills)[.]'").select("url")
    return url_filter(pages, listed)


_CANONICAL = rf"""
  select *, host || path || case when q = '' then '' else '?' || q end as canonical_url from (
    select *,
      regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^www\.', '') as host,
      regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
      array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^{TRACKING}(=|$)'))), '&') as q
    from (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') as bare from pages)
  )
"""
OP1_SQL = f"""
with c as ({_CANONICAL}),
bad as (select distinct canonical_url as k from c where canonical_url <> '' and (regexp_matches(url, 'utm_source=feed') or regexp_matches(url, '(spam-farm|cheap-pills)[.]')))
select page_id, url, canonical_url, bad.k is not null as listed from c left join bad on c.canonical_url = bad.k
"""
