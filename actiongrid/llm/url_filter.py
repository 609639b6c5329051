"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule names a host and a path; it fits that host and its subdomains where the url's path starts
with the rule's, and the longest rule that fits wins. Urls that a rule judges are the labelled
ones. From a bounded sample of them boosted trees learn from the look of a url alone: lengths,
depth, digit ratio, entropy, parameters, and how often labelled urls with the same suffix were
blocked. Suffix counts cover all labelled urls; suffixes share a fixed number of hashed cells.
"""

from __future__ import annotations

import math
import string
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, query, table

CELLS = 1024
#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without `://` or where it is null."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits; both null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, where, under in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends outermost
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(under)
        text, verdict = F.when(fits, F.lit(where + under)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def suffixes(host: str) -> tuple[str, str]:
    """The last label of a host, and its last two."""
    parts = host.split(".")
    return parts[-1], ".".join(parts[-2:])


def cell(suffix: str) -> int:
    return xxhash.xxh32_intdigest(suffix.encode("utf-8", "surrogatepass"), 3) % CELLS


def features(url: str | None, host: str, path: str, rates: np.ndarray) -> list[float]:
    url = url or ""
    n = max(len(url), 1)
    counts = Counter(url)
    tail = url.split("#", 1)[0].partition("?")[2]
    last = path.rsplit("/", 1)[-1]
    one, two = suffixes(host)
    return [
        len(url), len(host), len(path), path.count("/"), sum(map(counts.__getitem__, string.digits)) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()), tail.count("=") if tail else 0, tail.count("&") + 1 if tail else 0,
        host.count("."), counts["-"] + counts["_"], len(last), "." in last, "#" in url, url.startswith("https"),
        sum(map(str.isdigit, last)) / max(len(last), 1), rates[cell(one)], rates[cell(two)],
    ]


class Trees:
    """Boosted regression trees on the logistic loss, grown level by level over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64):
        self.depth = depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        binned, margin = self._bin(x), np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, p - y, p * (1 - p), rate, bins)
            self.trees.append(tree)
            margin += tree[2][leaf]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, binned, gradient, hessian, rate, bins):
        rows, width = binned.shape
        nodes = (1 << self.depth) - 1
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, bins)
        at = np.zeros(rows, np.int64)
        for level in range(self.depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.full(many, 1e-6)
            for f in range(width):
                key = (at - first) * bins + np.minimum(binned[:, f], bins - 1)
                g = np.bincount(key, gradient, many * bins).reshape(many, bins).cumsum(axis=1)
                h = np.bincount(key, hessian, many * bins).reshape(many, bins).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                gain[(h < 0.5) | (all_h - h < 0.5)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(many), top] > best
                best[better] = gain[np.arange(many), top][better]
                feature[first:first + many][better], cut[first:first + many][better] = f, top[better]
            at = 2 * at + 1 + (binned[np.arange(rows), feature[at]] > cut[at])
        leaf = at - nodes
        g, h = np.bincount(leaf, gradient, nodes + 1), np.bincount(leaf, hessian, nodes + 1)
        return (feature, cut, -rate * g / (h + 1)), leaf

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned, margin = self._bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            margin += value[at - len(feature)]
        return 1 / (1 + np.exp(-margin))


def _cells(host: pd.Series, which: int) -> pd.Series:
    return pd.Series([cell(suffixes(h)[which]) for h in host], dtype="int32")


def _rates(labelled: DataFrame) -> np.ndarray:
    """Smoothed share of blocked urls in every cell, over all labelled urls (at most CELLS rows)."""
    of = F.pandas_udf(lambda h: _cells(h, 0), "int"), F.pandas_udf(lambda h: _cells(h, 1), "int")
    hosts = labelled.groupBy("host").agg(F.sum("blocked").alias("bad"), F.count(F.lit(1)).alias("n"))
    cells = hosts.select(F.explode(F.array(of[0]("host"), of[1]("host"))).alias("cell"), "bad", "n")
    rates = np.full(CELLS, 0.5)
    for row in cells.groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).collect():
        rates[row["cell"]] = (row["bad"] + 5) / (row["n"] + 10)
    return rates


def fit(urls: DataFrame, label_col: str, max_rows: int = 20_000) -> tuple[Trees, np.ndarray] | None:
    """Trees and suffix rates from urls(url, host, path) whose label is `block` or `allow`.

    The trees see at most `max_rows` urls, drawn evenly from both labels by hash; the rates see
    all. None if nothing is labelled.
    """
    labelled = urls.where(F.col(label_col).isin("block", "allow")).select(
        "url", "host", "path", (F.col(label_col) == "block").cast("int").alias("blocked"))
    rates = _rates(labelled)
    rows = bounded_sample(labelled, "blocked", max_rows // 2, "url").toPandas()
    if not len(rows):
        return None
    x = np.array([features(u, h, p, rates) for u, h, p in zip(rows["url"], rows["host"], rows["path"])], np.float64)
    return Trees(x, rows["blocked"].to_numpy(np.float64)), rates


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", max_rows: int = 20_000) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, p_block) of every row of `pages`.

    p_block is the trees' probability. The verdict is the rule's; without one, `block` where
    p_block is at least a half. Null urls and urls without `://` have empty host and path and
    fit no rule. With nothing labelled every p_block is 0. Repeated rows repeat, other columns
    are left out.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "says": says})
    shared = pages.sparkSession.sparkContext.broadcast(fit(urls, "says", max_rows))  # bounded by max_rows and CELLS

    @F.pandas_udf("double")
    def p_block(url: pd.Series, host: pd.Series, path: pd.Series) -> pd.Series:
        if shared.value is None or not len(url):
            return pd.Series(np.zeros(len(url)))
        trees, rates = shared.value
        return pd.Series(trees.probability(np.array([features(u, h, p, rates) for u, h, p in zip(url, host, path)], np.float64)))

    urls = urls.withColumn("p_block", p_block("url", "host", "path"))
    verdict = F.coalesce("says", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return urls.select(F.col("page_id").alias(id_col), "url", "host", "path", "rule", verdict.alias("verdict"), "p_block")


RULES: list[Rule] = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query("op3_url_filter")
def op3_url_filter(spark, sf_dir):
    found = judge(table(spark, sf_dir, "pages"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "p_block")
