"""URL filters: a sort-merge range join of pages with host and path rules.

A host is turned round (``a.example.net`` to ``net.example.a.``), so a rule for a host and its
subdomains covers one interval of the sorted keys, and intervals nest or are disjoint. Keys are
cut into ranges of about equal numbers of rows; each rule is copied to the ranges its interval
meets; a sorted sweep of a range keeps the stack of rules that are open.

Scale: there are as many ranges as the count needs at ``rows_per_range`` rows each, and at least eight for
each shuffle partition. Their bounds come from a sample of about ``per_range`` keys for each range, and a row finds its range
by binary search. Bounds are pairs of key and salt, so one host or url with a third of all rows spreads over many ranges. Only
urls are shuffled, no other column. A task holds the stack (at most one level for each label of
a host) and one Arrow batch.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule, and
gets the default verdict. Of rules that fit, the one with the longest host plus path wins, and of equally long ones
the one with the longer host; a repeated rule counts once, and of two opposite rules for the same host and path ``block`` wins.
Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm.common import drawn

#: Rules as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url):
    """Columns host and path of a url."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_key(host):
    """``a.b.c`` as ``c.b.a.``; the empty host keeps an empty key, which no rule's interval holds."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def url_rules(pages: DataFrame, rules: DataFrame, rows_per_range: int = 4_000_000, per_range: int = 32, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``rules`` has host, path, verdict."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", reversed_key(F.col("host")).alias("key"), F.xxhash64("page_id", "host", "path").alias("salt"))
    count, partitions = pages.count(), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(-(-count // rows_per_range), 8 * partitions)
    share = min(1.0, per_range * ranges / max(count, 1))
    found = sorted((r["key"], r["salt"]) for r in urls.select("key", "salt").where(drawn("salt", F.lit(share))).collect())
    bounds = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
    limits = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).alias("salt")) for k, s in bounds]) if bounds else None

    def range_of(key, salt, strict=False):
        """How many bounds are not above (``strict``: below) a key, by halving the list."""
        if limits is None:
            return F.lit(0)
        at = F.struct(key.alias("key"), salt.alias("salt"))

        def halve(span, _):
            middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
            bound = F.get(limits, middle)
            below = (span["low"] < span["high"]) & ((bound < at) if strict else (bound <= at))
            return F.struct(F.when(below, middle + 1).otherwise(span["low"]).alias("low"), F.when(below | (span["low"] >= span["high"]), span["high"]).otherwise(middle).alias("high"))

        steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve, lambda span: span["low"])

    kinds = F.when(F.col("verdict") == "block", 0).otherwise(1)
    lowered = F.translate(F.col("host"), _UPPER, _LOWER)
    opens = rules.where("host IS NOT NULL AND host <> '' AND verdict IS NOT NULL").select(lowered.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    opens = opens.groupBy("host", "path").agg(F.min_by("verdict", kinds).alias("verdict")).withColumn("key", reversed_key(F.col("host")))
    upper = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))  # '/' follows '.' in byte order
    lowest, empty = F.lit(-(2**63)), F.lit(None)
    copies = opens.select("*", upper.alias("until"), F.explode(F.sequence(range_of(F.col("key"), lowest), range_of(upper, lowest, strict=True))).alias("range"))
    events = copies.select("range", "key", F.lit(0).alias("is_url"), empty.cast(dict(urls.dtypes)["page_id"]).alias("page_id"), "host", "path", "verdict", "until").unionByName(
        urls.select(range_of(F.col("key"), F.col("salt")).alias("range"), "key", F.lit(1).alias("is_url"), "page_id", "host", "path", empty.cast("string").alias("verdict"), empty.cast("string").alias("until"))
    )
    schema = urls.select("page_id", "host", "path").schema.add("rule", "string").add("verdict", "string")
    names = [f.name for f in schema]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # until, host, verdict by path, lengths of paths
        current = None
        for batch in batches:
            out = []
            for where, key, is_url, page, host, path, verdict, until in zip(*(c.to_pylist() for c in batch.columns)):
                if where != current:
                    stack, current = [], where
                while stack and stack[-1][0] <= key:
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][1] != host:
                        stack.append((until, host, {}, []))
                    stack[-1][2][path] = verdict
                    if len(path) not in stack[-1][3]:
                        stack[-1][3].append(len(path))
                    continue
                best = None
                for _, rule_host, by_path, lengths in stack:  # longer hosts come later
                    for n in lengths:
                        if (hit := by_path.get(path[:n])) is not None and len(path) >= n and (best is None or len(rule_host) + n >= best[0]):
                            best = (len(rule_host) + n, rule_host + path[:n], hit)
                out.append((page, host, path, best[1] if best else None, best[2] if best else default))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, [batch.schema.field("page_id").type] + [pa.string()] * 4)], names=names)

    # ranges outnumber partitions, so that two ranges that meet in one partition make no hot spot
    return events.repartition("range").sortWithinPartitions("range", "key", "is_url").mapInArrow(sweep, schema)
