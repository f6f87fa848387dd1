"""URL rules fetched through their rarest literal token (DataFrame functions only).

A rule is either a host rule (host, path prefix; longest wins; decides when one fits) or a pattern
(a regular expression over host and path, which blocks when no host rule fits). Every rule carries
literal tokens that any URL it fits must contain; the rule is indexed under the one that the fewest
URLs of the table hold. A URL looks up its own tokens, and only the rules fetched that way run
their regular expression. Rules without a literal token are fetched by every URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import save, small

#: (action, host, path prefix).
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: (regular expression over host + path in lower case, literal tokens that it cannot match without).
PATTERNS = (
    (r"(^|\.)(ads?|adserver|doubleclick|tracker|tracking)\d*\.[a-z0-9.-]+/", ()),
    (r"/(wp-login|xmlrpc)\.php$", ("php",)),
    (r"(^|[./-])(casino|poker|slots|betting)[./-]", ()),
    (r"(^|[./-])(porn|xxx|adult|escort)[./-]", ()),
    (r"(^|[./-])spam(mer|my)?[./-]", ()),
    (r"/cgi-bin/", ("cgi", "bin")),
    (r"/(login|signin|signup|register)(/|$|\.)", ()),
    (r"\.(exe|apk|torrent|iso|dmg)$", ()),
    (r"/tag/[^/]+/page/\d+", ("tag", "page")),
    (r"/search/", ("search",)),
    (r"(^|\.)(bit|tinyurl|goo)\.(ly|com|gl)/", ()),
)

_TOKEN = r"[a-z0-9]+"
#: Stands for "no literal token": every URL holds it.
_ANY = ""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for a null."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def rule_table(spark: SparkSession, host_rules: Sequence[tuple] = HOST_RULES, patterns: Sequence[tuple] = PATTERNS) -> DataFrame:
    """One row per rule: rule, verdict, rank (length of a host rule; 0 for a pattern), regex, tokens.

    A host rule is a pattern too: its labels and the whole tokens of its path are literal tokens.
    """
    import re

    rows = []
    for action, host, path in host_rules:
        inner = re.findall(_TOKEN, path.lower()) if path.endswith("/") else re.findall(_TOKEN + r"(?=[^a-z0-9])", path.lower())
        rows.append((host + path, action, len(host + path), rf"\A(?:[^/]*\.)?{_literal(host)}{_literal(path)}",
                     sorted(set(re.findall(_TOKEN, host.lower()) + inner))))
    for regex, tokens in patterns:
        rows.append((regex, "block", 0, regex, sorted(set(tokens))))
    return spark.createDataFrame(rows, "rule string, verdict string, rank int, regex string, tokens array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, verdict), one row per distinct url of ``pages``; rule is null where no host
    rule fits, and the verdict then is ``block`` if a pattern fits, else ``allow``."""
    host, path = host_and_path(F.col("url"))
    urls = save(pages.select("url").distinct().select("url", host.alias("host"), path.alias("path")), "urls")
    place = F.concat("host", "path")  # the path keeps its case; patterns and tokens see lower case
    held = urls.select("url", "host", "path", F.explode(F.array_union(
        F.array(F.lit(_ANY)), F.array_distinct(F.regexp_extract_all(F.lower(place), F.lit(f"({_TOKEN})"), F.lit(1))))).alias("token"))
    wanted = rules.select("rule", "verdict", "rank", "regex", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(_ANY)))).alias("token"))
    wanted = save(wanted, "rules")
    counts = held.join(small(wanted.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("pages"))
    index = (wanted.join(counts, "token", "left")
             .groupBy("rule", "verdict", "rank", "regex").agg(F.min(F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), "token"))["token"].alias("token")))
    index = save(index, "index")
    subject = F.when(F.col("rank") > 0, place).otherwise(F.lower(place))
    fits = held.join(small(index), "token").where(F.regexp_like(subject, F.col("regex")))
    best = fits.groupBy("url").agg(F.max(F.when(F.col("rank") > 0, F.struct("rank", "rule", "verdict"))).alias("host_rule"), F.max(F.when(F.col("rank") == 0, F.col("rule"))).alias("pattern"))
    return (urls.join(best.withColumnRenamed("url", "of"), F.col("url").eqNullSafe(F.col("of")), "left")
            .select("url", "host", "path", F.col("host_rule.rule").alias("rule"),
                    F.coalesce("host_rule.verdict", F.when(F.col("pattern").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "pattern"))


def url_filter(pages: DataFrame, host_rules: Sequence[tuple] = HOST_RULES, patterns: Sequence[tuple] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for every row of ``pages`` (page_id, url).

    A null or malformed url has empty host and path, no rule, and is allowed. Rows that repeat a url
    or a page_id are all judged, alike; a null page_id stays null. Host rules of equal length tie by
    text. An empty table gives an empty table; other columns are ignored.
    """
    rows = pages.select("page_id", "url")
    done = judge_urls(rows, rule_table(pages.sparkSession, host_rules, patterns)).withColumnRenamed("url", "of")
    return (rows.join(done, F.col("url").eqNullSafe(F.col("of")))
            .select("page_id", "host", "path", "rule", "verdict", "pattern"))
