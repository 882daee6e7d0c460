"""Weighted URL vocabulary: Aho-Corasick counts strict and soft terms with boundary checks.

A term hits where it stands in the lower-cased URL with no letter a-z or digit beside it. Every term has a
weight; a URL is rejected when the weights of its distinct terms reach the limit: one strict term does that
alone, soft ones only several together; repeats of a term count once. Rules by host and path prefix can
override that verdict.

The vocabulary is a dictionary or a table (term, weight), of which a repeated term has its largest weight. It goes
to the tasks in automata of at most VOCABULARY_BYTES of terms; several of them are searched in one pass.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and is
judged by its terms alone (null: allow). Null and empty terms, and null weights, are left out. Very long URLs are
searched whole. Repeated rows give repeated rows; an empty table gives an empty result; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = ("porn", "xxx", "hentai", "escort", "camgirl", "nsfw", "warez", "torrent")
SOFT = ("adult", "casino", "bet", "poker", "sex", "nude", "hot", "dating", "crack", "keygen", "pills", "loan", "jackpot", "slots", "viagra", "replica")
#: A soft term weighs half of what rejects a URL.
LIMIT = 1.0
VOCABULARY = {**dict.fromkeys(SOFT, 0.5), **dict.fromkeys(STRICT, 1.0)}
VOCABULARY_BYTES = 16 << 20
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BESIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def read_vocabulary(table: DataFrame) -> dict[str, float]:
    """Terms and weights of a table (term, weight)."""
    terms = table.select(F.translate(F.col("term"), _UPPER, _LOWER).alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> '' and weight is not null")
    return {r.term: r.weight for r in terms.groupBy("term").agg(F.max("weight").alias("weight")).toLocalIterator()}


def parts_of(vocabulary: Mapping[str, float], most: int = VOCABULARY_BYTES) -> Iterator[dict[str, float]]:
    """The vocabulary in parts of bounded bytes."""
    part, size = {}, 0
    for term, weight in vocabulary.items():
        if part and size + len(term.encode()) > most:
            yield part
            part, size = {}, 0
        part[term] = weight
        size += len(term.encode())
    yield part


def automaton(vocabulary: Mapping[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        found.add_word(term, (term, weight))
    if len(found):
        found.make_automaton()
    return found


def term_hits(machine: ahocorasick.Automaton, url: str | None, limit: float = LIMIT) -> tuple[int, int, float]:
    """Distinct strict and distinct soft terms in a URL, and the weight of all."""
    if not url or not len(machine):
        return 0, 0, 0.0
    low = url.translate(_TABLE)
    hits = {}
    for last, (term, weight) in machine.iter(low):
        first = last - len(term) + 1
        if (first == 0 or low[first - 1] not in _BESIDE) and (last + 1 == len(low) or low[last + 1] not in _BESIDE):
            hits[term] = weight
    strict = sum(x >= limit for x in hits.values())
    return strict, len(hits) - strict, float(sum(hits.values()))


_TABLE = str.maketrans(_UPPER, _LOWER)


def count_terms(vocabulary: Mapping[str, float] = VOCABULARY, limit: float = LIMIT):
    """A column function: struct<n_strict, n_soft, weight> of a URL column."""

    @F.pandas_udf("n_strict int, n_soft int, weight double")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(vocabulary)
        for part in parts:
            yield pd.DataFrame([term_hits(machine, x, limit) for x in part], columns=["n_strict", "n_soft", "weight"])

    return counted


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(of + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: Mapping[str, float] | DataFrame = VOCABULARY, limit: float = LIMIT, part_bytes: int = VOCABULARY_BYTES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, n_strict, n_soft of each row; a rule's verdict goes before the terms'."""
    terms = read_vocabulary(vocabulary) if isinstance(vocabulary, DataFrame) else vocabulary
    out = pages.select(F.col(id_column), F.col(url_column).alias("_url"))
    hits = F.array(*(count_terms(part, limit)(F.col("_url")) for part in parts_of(terms, part_bytes)))
    out = out.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url")), "_hits": hits})
    n_strict, n_soft, weight = (F.aggregate(f"_hits.{c}", F.lit(0).cast(kind), lambda s, x: s + x) for c, kind in (("n_strict", "int"), ("n_soft", "int"), ("weight", "double")))
    out = out.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    by_terms = F.when(weight >= limit, "block").otherwise("allow")
    return out.select(id_column, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_terms).alias("verdict"), n_strict.alias("n_strict"), n_soft.alias("n_soft"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle() -> str:
    def hits(terms):
        return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms)

    fits = {of + prefix: (v, f"((host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{prefix}'))") for v, of, prefix in RULES}
    longest = sorted(fits, key=len, reverse=True)
    rule = " ".join(f"WHEN {fits[r][1]} THEN '{r}'" for r in longest)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{fits[r][0]}'" for r in longest)
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low FROM pages),
p AS (SELECT page_id, low, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, {hits(STRICT)} AS n_strict, {hits(SOFT)} AS n_soft FROM p)
SELECT page_id, host, path, rule,
       CASE {verdict} WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n_strict AS INTEGER) AS n_strict, CAST(n_soft AS INTEGER) AS n_soft
FROM h"""
