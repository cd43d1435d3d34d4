"""Text functions as Spark column expressions; all but the edit distance stay inside generated code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Han ideographs (fixed values).
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}"


def strip(c: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case; Han runs become pairs of characters."""
    words = F.regexp_extract_all(F.lower(c), F.lit(rf"[\p{{L}}\p{{N}}&&[^{CJK}]]+|[{CJK}]+"), F.lit(0))
    pairs = lambda w: F.when(w.rlike(f"^[{CJK}]{{2,}}$"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))
    return F.coalesce(F.flatten(F.transform(words, pairs)), F.array().cast("array<string>"))


def context_tokens(c: Column) -> Column:
    """Estimate for contexts: each Han character, a quarter of each word (1 at least), a third of the rest."""
    han = F.regexp_count(c, F.lit(f"[{CJK}]"))
    words = F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    word_tokens = F.aggregate(words, F.lit(0), lambda a, w: a + F.greatest(F.lit(1), (F.length(w) / 4).cast("int")))
    chars = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return (han + word_tokens + F.floor((F.length(c) - han - chars) / 3)).cast("long")


def history_tokens(c: Column) -> Column:
    """Estimate for histories: half the characters, 1 at least, 0 for none."""
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 2))).cast("long")


def is_synthesis(*paths: Column) -> Column:
    """Whether the first path that is there lies in a folder of syntheses."""
    return F.coalesce(F.contains(F.replace(F.coalesce(*paths), F.lit("\\"), F.lit("/")), F.lit("syntheses")), F.lit(False))


def valid_session_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[\p{L}\p{N}_-]{1,64}$"), F.lit(False))


def sub_queries(c: Column, most: int) -> Column:
    """Lines without list marks and quotes, distinct in order, the first `most`."""
    bare = lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), r"^(?:\d+[.、)）:：]|[-*•])\s*", ""), "^[\"'“”]+|[\"'“”]+$", ""))
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(c, "\n"), bare), lambda x: F.length(x) > 0)), 1, most)


def judge_score(c: Column) -> Column:
    """`SCORE: x`, else the last number; whole numbers above 1 count as per cent; -1 outside 0 to 1."""
    named = F.regexp_extract(c, r"(?i)SCORE\s*[:：=]\s*(-?\d+(?:\.\d+)?)", 1)
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?<![\d.])\d+(?:\.\d+)?(?![\d.])"), F.lit(0)), F.lit(-1))
    x = F.coalesce(F.nullif(named, F.lit("")), last).try_cast("double")
    scaled = F.when((x > 1) & (x <= 100) & (x == F.floor(x)), x / 100).otherwise(x)
    return F.when(scaled.between(0, 1), scaled).otherwise(-1.0)


def edits(one: str, other: str) -> int:
    """Least number of characters put in, taken out or replaced. What both begin or end with is set aside; where as many
    characters have to change as stand at differing places, that is the number; all else goes through bit vectors."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (one, other))
    for _ in range(2):  # from the front, then from the back
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        same = int(differ[0]) if len(differ) else n
        x, y = x[same:][::-1], y[same:][::-1]
    if not len(x) or not len(y):
        return max(len(x), len(y))
    codes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    more = np.bincount(at[: len(x)], minlength=len(codes)) - np.bincount(at[len(x) :], minlength=len(codes))
    least = int(max(more[more > 0].sum(), -more[more < 0].sum()))
    most = int((x != y).sum()) if len(x) == len(y) else max(len(x), len(y))
    return least if least == most else edits_by_bits(at[: len(x)], at[len(x) :], len(codes))


def edits_by_bits(x: np.ndarray, y: np.ndarray, codes: int) -> int:
    """Edits between two lists of codes by Myers' bit vectors, a column of the table of edits at a time."""
    size, score = len(x), len(x)
    every = (1 << size) - 1
    has = [int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in range(codes)]
    up, down = every, 0  # where the column grows and where it falls by one
    for c in y.tolist():
        level = has[c] | down
        across = (((has[c] & up) + up) ^ up) | has[c]
        right, left = down | ~(across | up) & every, up & across
        score += (right >> size - 1 & 1) - (left >> size - 1 & 1)
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = left | ~(level | right) & every, right & level
    return score


def edit_distance(one: Column | str, other: Column | str) -> Column:
    """edits() as int; null where one side is null."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else edits(x, y) if x != y else 0 for x, y in zip(a, b, strict=True)], dtype="Int32")

    return distance(one, other)


def char_error_rate(reference: Column, got: Column) -> Column:
    """Edits a reference character; null without a reference."""
    return edit_distance(reference, F.coalesce(got, F.lit(""))) / F.nullif(F.length(reference), F.lit(0))


def preview(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def slug(c: Column) -> Column:
    """Letters and digits, other runs a hyphen, cut to 40 characters; `qa` for nothing."""
    s = F.regexp_replace(F.regexp_replace(c, rf"[^A-Za-z0-9{CJK}]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, 40)
    return F.when(F.length(s) == 0, "qa").otherwise(s)


def public_url(url: Column) -> Column:
    """http(s) URLs whose host is no local name and no private, loopback, link-local or reserved IPv4 address."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    # fixed values: the ranges that the address registries keep for private, local, test and later use
    private = r"^(?:0|10|127|2(?:2[4-9]|[345]\d))\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.0\.2\.|^192\.0\.0\.(?!9$|10$)|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
    dotted = host.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    six = host.startswith("[")
    bad6 = host.rlike(r"^\[(?:::|::1|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*|ff[0-9a-f:]*|::ffff:.*)\]$")
    return F.coalesce((F.length(host) > 0) & ~host.rlike(r"(^|\.)localhost$") & ~(dotted & host.rlike(private)) & ~(six & bad6), F.lit(False))


#: Punctuation of Han texts and what stands for it, character by character (fixed values); an ellipsis is three stops.
HAN_MARKS, PLAIN_MARKS = "。、《》【】「」『』“”‘’—–―　", ".,<>[]\"\"''\"\"''--- "
#: White space in the widest sense, which normal_ocr takes out.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def normal_ocr(c: Column, underscores: bool = False) -> Column:
    """Only the characters that OCR has to get right: full-width forms and Han punctuation become ASCII; table rules,
    leading # and >, the marks *, ~, ` and |, and all white space go. underscores: take them out too."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    t = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("——"), F.lit("—")), F.lit("……"), F.lit("…"))
    t = F.replace(F.translate(t, HAN_MARKS + wide, PLAIN_MARKS + narrow), F.lit("…"), F.lit("..."))
    rule = lambda x: x.rlike(rf"^(?:[|:-]|{SPACE})+$") & x.contains("-")
    kept = F.filter(F.split(t, "\n"), lambda x: ~rule(x))
    bare = F.transform(kept, lambda x: F.regexp_replace(x, rf"^{SPACE}*(?:#{{1,6}}{SPACE}*|>+{SPACE}*)+", ""))
    return F.regexp_replace(F.array_join(bare, ""), rf"[*~`|{'_' if underscores else ''}]|{SPACE}", "")


def page_title(found: Column, markdown: Column, url: Column) -> Column:
    """A page's title: the one found in it (of `<title>` or `<h1>`), else its first Markdown heading, else its host."""
    blank = lambda c: F.nullif(strip(c), F.lit(""))
    heading = blank(F.regexp_replace(F.regexp_extract(markdown, r"(?m)^(#.*)$", 1), "^#+", ""))
    return F.coalesce(blank(found), heading, F.regexp_extract(url, "://([^/?#]*)", 1))
