"""Quality rules over documents as a short-circuit cascade.

Each rule looks at a text's figures, some of which cost more than others to find. On a sample of documents
every rule's cost (seconds, its own figures included) and rejections are measured; rules then run in falling
order of rejections per cost, each only on the documents that the earlier ones kept. A document is kept when
no rule rejects it, so the order changes the work and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakequill.llm.text import SPACES, doc_bytes, mix64, with_bytes

NOT_STARTS = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
WINDOW = 8
_CODES = mix64(np.arange(1, 1 << 16, dtype=np.uint64))
_TURNS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)


def count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a k-word window which the list holds twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    codes = _CODES[ids] if len(seen) < len(_CODES) else mix64(ids.astype(np.uint64) + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += (codes[i : i + n] ^ (codes[i : i + n] >> np.uint64(17))) * _TURNS[i]
    ranked = np.sort(h)
    if (twice := ranked[1:][ranked[1:] == ranked[:-1]]).size == 0:
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(np.isin(h, twice))
    edge[hit] += 1
    edge[hit + k] -= 1
    return int((np.cumsum(edge) > 0).sum())


class Figures:
    """Figures of one text, each found when first asked for."""

    FOUND: dict[str, Callable[[Figures], object]] = {
        "words": lambda f: f.text.split(),
        "n_words": lambda f: len(f.words),
        "word_chars": lambda f: len(f.text.translate(None, SPACES + NOT_STARTS)),
        "n_symbols": lambda f: count(f.text, SYMBOLS),
        "lines": lambda f: [x for x in f.text.split(b"\n") if x and not x.isspace()],
        "n_dup_lines": lambda f: len(f.lines) - len(set(f.lines)),
        "n_repeat_words": lambda f: repeated_words(f.words),
        "n_same_words": lambda f: sum(map(bytes.__eq__, f.words, f.words[1:])),
        "n_upper": lambda f: count(f.text, UPPER),
        "n_lower": lambda f: count(f.text, LOWER),
        "n_bars": lambda f: f.text.count(b"|"),
        "n_bangs": lambda f: f.text.count(b"!"),
    }

    def __init__(self, text: bytes):
        self.text = text

    def __getattr__(self, name: str) -> object:
        if name not in self.FOUND:
            raise AttributeError(name)
        value = self.FOUND[name](self)
        setattr(self, name, value)
        return value


@dataclass(frozen=True)
class Rule:
    """`rejects` tells from a text's figures whether the text goes."""

    name: str
    rejects: Callable[[Figures], bool]


#: A text goes when it is too short or repeats itself.
BASE = (
    Rule("few_words", lambda f: f.n_words < 20),
    Rule("repeats", lambda f: 100 * f.n_repeat_words > 30 * f.n_words),
)
#: And when marks, capitals, table bars, or words or lines said again take up too much of it.
RULES = (
    Rule("symbols", lambda f: 100 * f.n_symbols > 15 * f.word_chars),
    Rule("capitals", lambda f: 100 * f.n_upper > 40 * (f.n_upper + f.n_lower)),
    Rule("bars", lambda f: 100 * f.n_bars > 15 * f.n_words),
    Rule("bangs", lambda f: 100 * f.n_bangs > 15 * f.n_words),
    Rule("same_words", lambda f: 100 * f.n_same_words > 20 * f.n_words),
    Rule("same_lines", lambda f: 100 * f.n_dup_lines > 40 * len(f.lines)),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...], sample: int) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) on the first `sample` documents that Spark hands out."""
    texts = [bytes(r.text) for r in doc_bytes(docs).limit(sample).toLocalIterator()]
    out = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(rule.rejects(Figures(t)) for t in texts)
        out.append((rule.name, (time.perf_counter() - began) / max(1, len(texts)), rejected / max(1, len(texts))))
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...], sample: int) -> tuple[Rule, ...]:
    """The rules in falling order of rejections per cost; equal ones by name."""
    rate = {name: (-share / max(cost, 1e-9), name) for name, cost, share in measure(docs, rules, sample)}
    return tuple(sorted(rules, key=lambda r: rate[r.name]))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, figures: tuple[str, ...] = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), sample: int = 200) -> DataFrame:
    """doc_id, the asked figures, base_failed and kept for every document.

    docs: doc_id, text; other columns are ignored. The sample of `sample` documents decides only the order in
    which rules run. A null or empty text has no words, so it fails `few_words`; a null doc_id stays null;
    repeated rows are judged each; an empty table gives no rows. Texts are never cut. Pass figures=() to find
    only what the rules need; base and rules then run as one cascade.
    """
    if figures:
        first, rest = base, plan(docs, rules, sample)
    else:
        first, rest = (), plan(docs, (*base, *rules), sample)
    schema = "doc_id long, " + "".join(f"{x} long, " for x in figures) + "base_failed boolean, kept boolean"
    names = ["doc_id", *figures, "base_failed", "kept"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                f = Figures(text.as_buffer().to_pybytes())
                found = [getattr(f, x) for x in figures]
                failed = any(r.rejects(f) for r in first)
                rows.append((*found, failed, not failed and not any(r.rejects(f) for r in rest)))
            columns = zip(*rows, strict=True) if rows else [()] * (len(names) - 1)
            kinds = [pa.int64()] * len(figures) + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return doc_bytes(docs).mapInArrow(judge, schema)


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE, *RULES), sample: int = 200) -> DataFrame:
    """The documents, with all their columns, that no rule rejects; all rules run as one cascade."""
    order = plan(docs, rules, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(batch.num_columns - 1):
                f = Figures(text.as_buffer().to_pybytes())
                keep.append(not any(r.rejects(f) for r in order))
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep, pa.bool_()))

    return with_bytes(docs).mapInArrow(run, docs.schema)
