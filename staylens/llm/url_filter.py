"""URL filter (DataFrame functions only): host-suffix x path-prefix expressions, hash-prefix join, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

PREFIX_HEX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end with
    A-Z lower-cased; path runs from there to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    raw = F.substring_index(rest, "/", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.substring(rest, F.length(raw) + F.lit(1), F.length(rest))


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's url by ``rules`` (host, path, action); keeps all rows and their columns.

    A rule fits its host and all subdomains when the url's path starts with the rule's path. Each url is
    expanded into host suffixes (of as many labels as some rule's host has) times path prefixes (of lengths
    that some rule's path has), so expansion is bounded by the rules, not by the url's length. Expressions
    are joined with the rules on a short prefix of their SHA-256, and a hit counts only if the full digest
    agrees. The longest rule text wins; at equal length ``block`` goes before ``allow``, then text order.

    Added columns: ``_host``, ``_path``, ``_rule`` (null if none fits), ``_verdict`` (the rule's action, else
    ``default``). Rules with a null part or an empty host are ignored, repeated rules count once; null and
    malformed urls fit no rule; repeated rows each get their row; an empty rule table gives ``default``
    everywhere. Verdicts are computed once per distinct url, so a url that fills a third of the rows is one
    row until the last join, whose skewed side AQE splits. Columns named like the added ones are replaced, all others are kept.
    """
    rules = (rules.select("host", "path", "action").where("host is not null and path is not null and action is not null and host != ''").distinct()
             .select(F.concat("host", "path").alias("rule"), "action", F.sha2(F.concat_ws("\x01", "host", "path"), 256).alias("digest"),
                     F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")))
    # one winner per expression, so a url meets each of its expressions once
    rank = F.struct(F.length("rule").alias("n"), (F.col("action") == "block").cast("int").alias("b"),
                    F.col("rule").alias("r"), F.col("action").alias("a"))
    best = rules.groupBy("digest").agg(F.max(rank).alias("best")).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    # the label counts and path lengths that occur in rules, as two scalar subqueries
    labels, chars = (rules.agg(F.collect_set(c)).scalar() for c in ("labels", "chars"))
    host, path = url_parts(F.col("_url"))
    urls = pages.select(F.coalesce(F.col(url), F.lit("")).alias("_url")).distinct().withColumns({"_host": host, "_path": path})
    wide = (urls.where("_host != ''").withColumns({"_labels": labels, "_chars": chars})
            .select("_url", "_path", "_chars", F.explode(F.expr(
                "transform(filter(_labels, k -> k <= size(split(_host, '[.]'))), k -> substring_index(_host, '.', -k))")).alias("_s"))
            .select("_url", "_s", F.explode(F.expr(
                "transform(filter(_chars, k -> k <= length(_path)), k -> substring(_path, 1, k))")).alias("_p")))
    keyed = wide.select("_url", F.sha2(F.concat_ws("\x01", "_s", "_p"), 256).alias("_digest"))
    hits = (keyed.join(best, F.substring("_digest", 1, PREFIX_HEX) == F.col("short"))
            .where(F.col("_digest") == F.col("digest")).groupBy("_url").agg(F.max("best").alias("_best")))
    host, path = url_parts(F.col(url))
    key, best = fresh_name(pages, "_url"), fresh_name(pages, "_best")
    return (pages.withColumn(key, F.coalesce(F.col(url), F.lit(""))).join(hits.withColumnsRenamed({"_url": key, "_best": best}), key, "left")
            .withColumns({"_host": host, "_path": path, "_rule": F.col(f"{best}.r"), "_verdict": F.coalesce(f"{best}.a", F.lit(default))})
            .drop(key, best))
