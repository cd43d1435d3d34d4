"""The words before a word are contexts of the language model (findings of round 4)."""

import zlib
from collections import Counter

import numpy as np
import pytest

from lakequill.llm import lm_scoring


def test_words_before_tell_the_next(spark):
    """All words are as common, and each follows from the two before it but for one in ten."""
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(300):
        words = [*rng.integers(0, 40, 2)]
        for _ in range(80):
            words.append((3 * words[-1] + (words[-2] % 2) * 7 + 1) % 40 if rng.random() < 0.9 else rng.integers(0, 40))
        texts.append(" ".join(f"w{w}" for w in words))
    rows = lm_scoring.score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3), (7, 2)).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 300 and len(held) > 20
    base, got = (sum(r[c] for r in held) / sum(r.n_tokens for r in held) for c in ("base_score", "score"))
    assert base < -1.5 and got > -0.8


def followers(rng, n, common):
    return [rng.integers(0, 6, n).astype(np.uint32), rng.integers(0, 3, n).astype(np.uint32), rng.integers(0, common + 1, n).astype(np.uint32), rng.integers(0, 2, n).astype(np.uint8), (rng.random(n) < 0.8).astype(np.uint8)]


def test_places_after_words_are_a_distribution(monkeypatch):
    monkeypatch.setattr(lm_scoring, "PLACE", 4)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (lm_scoring.TOPICS, 17)).astype(float)
    odds, alone = lm_scoring.common_odds(counts), lm_scoring.common_scores(counts)
    tokens = followers(rng, 3000, 16)
    asked = [np.array(x) for x in zip(*[(b, f, p, t, 0) for b in range(8) for f in range(4) for t in range(2) for p in range(17)])]
    score = lm_scoring.context_scores(*(np.concatenate((x, y.astype(x.dtype))) for x, y in zip(tokens, asked)), odds, alone)
    assert (10 ** score[3000:]).reshape(-1, 17).sum(1) == pytest.approx(np.ones(64), rel=1e-6)
    assert score[-17:] == pytest.approx(alone[1])  # after a word that no training text has
    turn = rng.permutation(3000)
    again = lm_scoring.context_scores(*(x[turn] for x in tokens), odds, alone)
    assert again == pytest.approx(score[:3000][turn])


def test_counts_after_contexts():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 4, 200) << 5 | rng.integers(0, 20, 200)).astype(np.uint64)
    n = rng.integers(0, 4, len(key)).astype(np.float32)
    turn = rng.permutation(len(key))
    after = lm_scoring.Followers(key[turn], n[turn], np.argsort(turn))
    for shift in range(4, -1, -1):
        one, said = after.bit(shift)
        seen, ones = Counter(), Counter()
        for k, x in zip(key.tolist(), n.tolist()):
            seen[k >> shift + 1] += x
            ones[k >> shift + 1] += x * (k >> shift & 1)
        for (odds, met), less in zip(said, (0, 1)):
            b = np.array([max(seen[k >> shift + 1] - less, 0) for k in key[turn].tolist()])
            a = np.array([max(ones[k >> shift + 1] - less * (k >> shift & 1), 0) for k in key[turn].tolist()])
            taught = n[turn] >= less
            assert odds[taught] == pytest.approx(lm_scoring.log_odds(a, b)[taught], rel=1e-4, abs=1e-5)
            assert met[taught].tolist() == [sum(x >= y for y in (1, 3, 15, 63)) for x in b[taught].tolist()]


def test_equal_rows_and_one_bucket_a_word(spark, monkeypatch):
    """Scores are the same where rows stand twice, and each text has one score whatever the buckets."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e"], 30))) for i in range(120)]
    one = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), (7, 2)).collect()}
    monkeypatch.setattr(lm_scoring, "BUCKET", 500)
    monkeypatch.setattr(lm_scoring, "HOT", 200)
    many = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), (7, 2)).collect()}
    assert many == pytest.approx(one, rel=0.1) and len(many) == 120
    held = next(i for i in range(120) if zlib.crc32(str(i).encode()) % 7 == 2)
    twice = lm_scoring.score(spark.createDataFrame([*rows, rows[held], (None, None)], "doc_id long, text string"), (7, 2)).collect()
    same = [r.score for r in twice if r.doc_id == held]
    assert len(twice) == 122 and len(same) == 2 and same[0] == same[1] and all(r.score < 0 for r in twice)
