"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host`` or ``host + path`` together with literal tokens that each url it fits
must hold.  The index files each rule under the one of its tokens that is rarest over all urls.  A url is split into
tokens; they fetch the candidate rules; only those run their regular expression.

Rules are a tuple, or a table of any size (``rules_table``).  Up to ``SEND_RULES`` the index goes to every task; beyond, the
urls' tokens meet it in a join, of which tokens that very many urls hold are dropped beforehand where no rule is filed
under them and split by url where one is.  Both ways give the same.

Defined cases: null urls and urls without ``://`` have an empty host and path and no rule, so the default verdict
``allow``; repeated rows are judged alike; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeline.llm.common import cut

TOKENS = r"[a-z0-9]+"
#: With more rules than this the index is joined by shuffle instead of being sent to each task.
SEND_RULES = 50_000
#: Urls of one token that a join brings to one place.
HOT_URLS = 1_000_000
RULES = "regex string, tokens array<string>, verdict string, rank int, name string"


@dataclass(frozen=True)
class Rule:
    """``order``: the larger wins; ``name`` is reported (null for rules that give a verdict only)."""

    regex: str
    tokens: tuple[str, ...]
    verdict: str
    order: int
    name: str | None = None


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host``, its subdomains, and paths that start with ``path``; longer rules win."""
    return Rule(rf"^(?:[^/]*\.)?{re.escape(host)}\n{re.escape(path)}", tuple(re.findall(TOKENS, host)), verdict, 1000 + len(host) + len(path), host + path)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Fits hosts in which ``word`` stands between the host's start, dots, hyphens and end."""
    return Rule(rf"^(?:[^\n]*[.-])?{re.escape(word)}[.\n-]", tuple(re.findall(TOKENS, word)), verdict, 1)


#: Contract rules, then the method's own for hosts without one.
SITE_RULES = (host_rule("net", "/", "block"), host_rule("example.net", "/en/", "allow"), host_rule("example.com", "/de/", "block"), host_rule("org", "/fr/", "allow"))
WORD_RULES = tuple(map(word_rule, ("ads-track", "adserver", "doubleclick", "tracker", "adult-x", "adult", "porn", "xxx", "casino", "spam-farm", "malware", "phishing")))


def with_parts(pages: DataFrame) -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lower, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def token_counts(parts: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """Number of urls that hold each token of the rules (at most as many rows as the rules have tokens)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    table = parts.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    if len(wanted) <= SEND_RULES:  # common tokens are counted before they are shuffled
        table = F.broadcast(table)
    seen = parts.select(F.explode(_tokens_column()).alias("token")).join(table, "token", "left_semi").groupBy("token").count()
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in seen.collect()}


def _tokens_column():
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws("/", "host", "path")), F.lit(f"({TOKENS})"), F.lit(1)))


def rarest_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"rule {rule} has no literal token")
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return index


def rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """``regex, tokens, verdict, rank, name`` of rules: the form in which a list of any size is read."""
    return spark.createDataFrame([(r.regex, list(r.tokens), r.verdict, r.order, r.name) for r in rules], RULES)


def judge(parts: DataFrame, rules: DataFrame | tuple[Rule, ...], default: str = "allow", send_rules: int = SEND_RULES, hot_urls: int = HOT_URLS) -> DataFrame:
    """Add ``rule`` and ``verdict`` to a table with ``host`` and ``path``, in place of columns of that name."""
    if not isinstance(rules, DataFrame) and len(rules) > send_rules:
        rules = rules_table(parts.sparkSession, rules)
    if isinstance(rules, DataFrame):
        some = rules.select("regex", "tokens", "verdict", "rank", "name").limit(send_rules + 1).collect()
        if len(some) > send_rules:
            return _judge_by_join(parts.drop("rule", "verdict"), rules, default, hot_urls)
        rules = tuple(Rule(r["regex"], tuple(r["tokens"]), r["verdict"], r["rank"], r["name"]) for r in some)
    parts = parts.drop("rule", "verdict")
    index = rarest_index(rules, token_counts(parts, rules))
    schema = parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit("").alias("verdict")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = {t: [(re.compile(r.regex), r) for r in sorted(rs, key=lambda r: -r.order)] for t, rs in index.items()}
        split = re.compile(TOKENS).findall
        for batch in batches:
            names, verdicts = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                best, joined = None, f"{host}\n{path}"
                for token in set(split(joined.lower())):
                    for regex, rule in filed.get(token, ()):
                        if (best is None or (rule.order, rule.regex) > (best.order, best.regex)) and regex.search(joined):
                            best = rule
                names.append(best.name if best else None)
                verdicts.append(best.verdict if best else default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(run, schema)


def filed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``token`` and the rules filed under it: each under its rarest by ``token, count``."""
    one = F.struct("regex", F.col("verdict").alias("rule_verdict"), F.col("rank").alias("rule_order"), "name").alias("one")
    token = F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("no literal token in rule "), F.col("regex"))).cast("array<string>")))
    rows = rules.select(one, token.alias("token")).join(counts, "token", "left")
    rarest = rows.groupBy("one").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rarest.select("token", "one.*")


def _judge_by_join(parts: DataFrame, rules: DataFrame, default: str, hot_urls: int) -> DataFrame:
    """For rule lists of any size: distinct urls meet the index by token in a join; verdicts come back by url."""
    urls = parts.select("host", "path").distinct()
    tokens = urls.withColumn("token", F.explode(_tokens_column()))
    counts = cut(tokens.groupBy("token").count())
    index = cut(filed(rules, counts))
    # Tokens of very many urls: at most as many as there are tokens in all urls, by ``hot_urls``.
    hot = counts.where(F.col("count") > hot_urls).join(index.select("token").distinct().withColumn("used", F.lit(True)), "token", "left")
    hot = cut(hot.select("token", F.ceil(F.col("count") / hot_urls).cast("int").alias("parts"), F.coalesce("used", F.lit(False)).alias("used")))
    split = lambda df: df.join(F.broadcast(hot), "token", "left").where(F.coalesce("used", F.lit(True))).withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = split(tokens).withColumn("part", F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int")).drop("parts", "used")
    table = split(index).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "used")
    fits = asked.join(table, ["token", "part"]).where(F.expr("concat(host, '\\n', path) rlike regex"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("name", "rule_verdict"), F.struct("rule_order", "regex")).alias("best"))
    rows = parts.select(F.struct("*").alias("row"), "host", "path")
    out = rows.join(best, ["host", "path"], "left")
    return out.select("row.*", F.col("best.name").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
