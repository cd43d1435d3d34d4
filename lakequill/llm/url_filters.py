"""URL filters: host and path rules, then a logistic regression on hashed character n-grams.

The regression sees character 3- to 5-grams of the host and of the path (marked apart), hashed to a fixed
number of columns, and is trained by full-batch gradient descent from a small labelled table of URLs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The labelled table: kinds of sites to block (1) and to allow (0), each as common words of site names.
BLOCKED = ("casino-win", "free-bets", "cheap-pills", "spam-farm", "adult-x", "ads-track", "casino-slots", "bets-online", "pills-shop", "adult-cams", "spam-links", "ads-click", "win-cash", "free-pills", "cheap-meds", "track-ads")
ALLOWED = ("library", "news-daily", "school", "museum", "garden", "city-guide", "research", "weather", "cooking", "travel", "open-data", "history", "science", "the-post", "university", "orchestra", "mountain", "hospital", "theatre", "language", "painting", "railway", "football", "gardener")


def labelled(spark: SparkSession) -> DataFrame:
    """url, label: each site of the lists above with a few prefixes, endings and paths."""
    shapes = [(p, e, t) for p in ("", "www.", "m.", "blog.") for e, t in (("com", "/en/12"), ("net", "/fr/345/"), ("org", "/de/67.html"))]
    rows = [(f"https://{p}{name}.example.{e}{t}", label) for label, names in ((1, BLOCKED), (0, ALLOWED)) for name in names for p, e, t in shapes]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """From the first :// up to a slash, question mark, hash or the end, A-Z in lower case; empty without ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: str, path: str, bits: int) -> np.ndarray:
    """Distinct hashed columns of the n-grams of a host and a path."""
    out = set()
    for mark, part in (("h", f"^{host}$"), ("p", path + "$")):
        for n in (3, 4, 5):
            out.update(mark + part[i : i + n] for i in range(len(part) - n + 1))
    return np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) & ((1 << bits) - 1) for x in out), np.int64, len(out))


def train(table: DataFrame, bits: int = 16, rounds: int = 300, rate: float = 2.0, decay: float = 1e-3, most: int = 10_000) -> tuple[np.ndarray, float]:
    """Weights and bias from (url, label) rows; at most `most` rows, in order of url, are used."""
    rows = table.where("label is not null").select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), "label").orderBy("url").limit(most).collect()
    x = [grams(r.h, r.p, bits) for r in rows]
    y = np.array([r.label for r in rows], float)
    w, b = np.zeros(1 << bits), 0.0
    row = np.repeat(np.arange(len(x)), [len(i) for i in x])
    column = np.concatenate(x) if x else np.zeros(0, int)
    scale = 1 / np.sqrt(np.maximum([len(i) for i in x], 1)) if x else np.zeros(0)
    for _ in range(rounds if x else 0):
        z = np.bincount(row, w[column], len(x)) * scale + b
        off = (1 / (1 + np.exp(-z)) - y) / len(x)
        w -= rate * (np.bincount(column, (off * scale)[row], 1 << bits) + decay * w)
        b -= rate * off.sum()
    return w, b


def judge(pages: DataFrame, table: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, bits: int = 16, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score for every page.

    pages: page_id, url; other columns are ignored. A rule fits its host and all subdomains when the path
    starts with the rule's; of several, the longest wins. Without one, a score (probability of `block`) of
    `threshold` or more blocks. A null url, or one without ://, has an empty host and path, fits no rule and is
    judged by the model. A null page_id is kept; repeated rows are judged each; an empty table gives none.
    The weights, of a fixed size, go out with the tasks.
    """
    w, b = train(table, bits)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([float(1 / (1 + np.exp(-(w[i := grams(h, p, bits)].sum() / np.sqrt(max(len(i), 1)) + b)))) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    out = split.withColumns({"rule": rule, "by_rule": verdict, "score": F.pandas_udf(score, "double")("host", "path")})
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))
