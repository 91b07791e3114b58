"""op12: verdicts on the URLs of pages, by rules and, where none fits, by the character models."""

from pyspark.sql import functions as F

from ..common import table
from ..url_filter import judged

NAME = "op12_url_filter"
SQL = None

#: Host, path and verdict of each rule.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url):
    """(host, path) of a URL: both empty where it is null or has no ://."""
    part = lambda g: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", g), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_of(host, path, value):
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for own_host, own_path, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(own_path))
        out = F.when(fits, F.lit(value(own_host + own_path, verdict))).otherwise(out)
    return out


def query(spark, sf_dir):
    host, path = parts(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = (rule_of(F.col("host"), F.col("path"), v) for v in (lambda r, v: r, lambda r, v: v))
    pages = pages.withColumn("rule", rule).withColumn("ruled", verdict)
    made, name = judged(pages, F.col("ruled") == "allow", F.col("host"))
    own = F.col(name)
    return made.select("page_id", "host", "path", "rule", F.when(own["allow"], "allow").otherwise("block").alias("verdict"), own["score"].alias("score"))
