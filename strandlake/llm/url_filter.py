"""Allow and block rules for URLs by host suffix and path prefix.

A rule such as ``example.org/es/`` fits its host and all hosts below it, where the path starts with the rule's. Each URL
is expanded into the expressions that a rule could equal: the host's last labels, joined with a table of how many path
characters rules with so many labels have, then the path's first characters. Expressions meet rules by the first four
bytes of their SHA-256, then the full digests must agree; of the rules that fit, the longest one decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_few, scratch, written

#: Tables up to so many bytes go to every executor; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Host and path columns of a url: what is between the first :// and the next /, ? or #, A-Z lowered; then up to ? or #."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _expression(host, path):
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", *, id_col: str = "page_id", url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has host, path and verdict (allow or block). The longest rule (host and path together) wins, then the one
    with the longer host, then block; without a rule the verdict is ``default`` and the rule null. A null url, or one
    without ://, has an empty host and path, which no rule fits. A rule with a null host, path or verdict is ignored.
    Equal rows get equal results; ids may be null. What is judged is each distinct (host, path), so a url that fills a
    third of the table is judged once, and its rows stay where they are. Rules travel to all executors up to
    ``broadcast_bytes``; beyond, urls' expressions and rules are shuffled by the prefix, with the same result.
    """
    folder = scratch(pages.sparkSession, "urls")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.lower("verdict").alias("r_verdict")).na.drop().where("r_host != ''")
    known = rules.select("r_host", "r_path", "r_verdict", _expression(F.col("r_host"), F.col("r_path")).alias("digest")).distinct()
    known = written(known.withColumn("prefix", F.substring("digest", 1, 4)), f"{folder}/rules")
    shapes = written(known.groupBy(F.size(F.split("r_host", r"\.")).alias("labels")).agg(F.collect_set(F.length("r_path")).alias("chars")), f"{folder}/shapes")

    def sized(df: DataFrame, size) -> DataFrame:
        n = df.agg(F.sum(size + 64)).first()[0] or 0
        return F.broadcast(df) if n <= broadcast_bytes else df

    host, path = host_and_path(pages[url_col])
    urls = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    each = written(urls.groupBy("host", "path").agg(F.count("*").alias("n")), f"{folder}/urls")
    most = shapes.agg(F.max("labels")).first()[0] or 0
    suffixes = each.where("host != ''").select("host", "path", F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(max(1, most))))).alias("labels"))
    asked = suffixes.join(sized(shapes, F.size("chars") * 4), "labels").select("host", "path", "labels", F.explode(F.filter("chars", lambda k: k <= F.length("path"))).alias("k"))
    own = _expression(F.expr("substring_index(host, '.', -labels)"), F.expr("substring(path, 1, k)"))
    asked = asked.select("host", "path", own.alias("e")).withColumn("prefix", F.substring("e", 1, 4))
    met = asked.join(sized(known, F.length("r_host") + F.length("r_path") + 48), "prefix").where("e = digest")
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("length"), F.length("r_host").alias("host_n"), (F.col("r_verdict") == "block").alias("block"), "r_host", "r_path", "r_verdict")
    best = met.groupBy("host", "path").agg(F.max(order).alias("best"))
    judged = written(each.join(best, ["host", "path"], "left"), f"{folder}/judged")
    return join_few(urls, judged, ["host", "path"], "n").select("page_id", "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
