"""URL filters as a sort-merge range join over reversed-host keys.

A host read backwards by labels turns "this host and all its subdomains" into one interval of keys, and the
intervals of two rules are either nested or apart. Rules and URLs are dealt into key ranges, a rule to each range
that it overlaps; in each range one sorted sweep keeps the rules around the current key on a stack.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import scratch

ALLOW, BLOCK = "allow", "block"
#: Split points are chosen from a sample of about this many keys for each range; every row is judged.
SAMPLE_PER_RANGE, KEY_LETTERS = 20, 400
#: URLs in a range, about, and how many ranges there are at most: the driver and the tasks hold so many cuts, and the driver
#: the sample. A range is swept as a sorted stream, so it may be of any size.
RANGE_ROWS, MAX_RANGES = 1_000_000, 10_000


def url_parts(url: str):
    """(host, path) columns: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?`` or ``#``."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + F.lit(3), F.length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host):
    """com.example.www. for www.example.com; what lies below a host starts with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


FIELDS = {"part": pa.int32(), "key": pa.string(), "is_url": pa.bool_(), "row": pa.int64(), "host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string()}
SCHEMA = "part int, key string, is_url boolean, row long, host string, path string, rule string, verdict string"


def _sweep(default: str):
    """Rows sorted by (range, key, rules first): a stack of the rules whose interval holds the current key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[tuple[str, str, str]]]] = []
        part = None
        for batch in batches:
            at, rule, verdict = [], [], []
            for i, (p, key, is_url, way, name, what) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "key", "is_url", "path", "rule", "verdict")))):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if stack and stack[-1][0] == key:
                        stack[-1][1].append((way, name, what))
                    else:
                        stack.append((key, [(way, name, what)]))
                    continue
                fits = [(len(rname), depth, rname, rwhat) for depth, (_, rules) in enumerate(stack) for rway, rname, rwhat in rules if way.startswith(rway)]
                best = max(fits, default=(0, 0, None, default))
                at.append(i)
                rule.append(best[2])
                verdict.append(best[3])
            urls = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([urls.column("row"), urls.column("host"), urls.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["row", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW, ranges: int | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the URL's path starts with the rule's
    path; of several the longest host and path together wins, then the deeper host. Of two rules with the same host
    and path, ``block`` wins. Without a rule the verdict is ``default`` and the rule null. A null or odd URL (without
    ``://``) has an empty host and path and no rule; rules with a null host or path are ignored. ``key`` is a long
    column; repeated keys get a row each, a null key stays null. Only ``key`` and ``url`` are read.

    A host with any share of the rows is dealt over several ranges, as keys go on with path and a salt; the rules
    around a range's first key, a few labels deep, are what is copied. Very long URLs are judged whole; an empty table gives
    an empty result, and columns of other names are ignored.
    """
    spark = pages.sparkSession
    host, path = url_parts(url)
    urls = pages.select(F.col(key).cast("long").alias("row"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    urls = urls.withColumn("sort", F.concat("key", F.lit("\x00"), "path", F.lit("\x00"), F.hex(F.xxhash64("row", F.lit(1)))))
    urls = scratch(urls, "urls")
    total = urls.count()
    n = ranges or min(MAX_RANGES, max(1, total // RANGE_ROWS, min(total // 1000, 2 * spark.sparkContext.defaultParallelism)))
    share = min(1.0, n * SAMPLE_PER_RANGE / max(total, 1))
    # About n * SAMPLE_PER_RANGE keys, their first KEY_LETTERS only: any cut will do.
    seen = sorted(r[0] for r in urls.select(F.substring("sort", 1, KEY_LETTERS)).sample(share, 11).limit(2 * n * SAMPLE_PER_RANGE).collect())
    cuts = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []

    def place(batches):
        for batch in batches:
            part = pa.array([bisect_right(cuts, x) for x in batch.column("sort").to_pylist()], pa.int32())
            none = pa.nulls(len(part), pa.string())
            yield pa.RecordBatch.from_arrays([part, batch.column("key"), pa.array([True] * len(part)), batch.column("row"), batch.column("host"), batch.column("path"), none, none], list(FIELDS))

    def spread(batches):
        for batch in batches:
            out = [
                (part, key, False, None, None, way, name, what)
                for key, way, name, what in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "rule", "verdict")))
                for part in range(bisect_right(cuts, key), bisect_left(cuts, key + chr(0x10FFFF)) + 1)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(FIELDS), FIELDS.values())], list(FIELDS))

    lines = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lines = lines.select(host_key(F.lower("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    both = urls.select("key", "sort", "row", "host", "path").mapInArrow(place, SCHEMA).unionByName(lines.mapInArrow(spread, SCHEMA))
    dealt = both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "key", "is_url")
    return dealt.mapInArrow(_sweep(default), "row long, host string, path string, rule string, verdict string").withColumnRenamed("row", key)


#: Fixed values of the query's contract: (host, path, verdict).
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]

OP4_SQL = """
WITH found AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS i FROM pages
), rest AS (
  SELECT page_id, CASE WHEN i > 0 THEN substr(url, i + 3) ELSE '' END AS rest FROM found
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


def op4(spark, sf_dir: str) -> DataFrame:
    """The query: every page's URL against the five rules of the contract."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
