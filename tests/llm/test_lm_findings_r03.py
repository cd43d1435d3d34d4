"""The language model reads each slot of its tables once, and the topic only where it may change (findings of round 3)."""

import numpy as np
import pytest

from lakequill.llm import lm_scoring


def test_readings_are_the_log_odds_of_the_slots():
    seen = np.array([0, 1, 2, 4, 16, 70, 300], np.float32)
    ones = np.array([0, 1, 0, 3, 9, 70, 1], np.float32)
    for without in (False, True):
        (read,) = lm_scoring.readings([(ones, seen)], without)
        got = read.view("<f4")[::2], read.view("<u4")[1::2]
        if without:  # a slot's zero, then its one
            ones_, seen_ = np.stack([ones, ones - 1], 1).ravel(), np.repeat(seen - 1, 2)
        else:
            ones_, seen_ = ones, seen
        seen_ = np.maximum(seen_, 0)
        assert got[0] == pytest.approx(lm_scoring.log_odds(np.clip(ones_, 0, seen_), seen_), rel=1e-5)
        assert got[1].tolist() == [4 + lm_scoring.sureness(x) if x > 0 else 0 for x in seen_]


def test_topics_before_each_token():
    rng = np.random.default_rng(2)
    topics = lm_scoring.Topics(rng.integers(0, 90, (lm_scoring.TOPICS, lm_scoring.TOPICAL)).astype(float))
    texts = [rng.integers(-1, 600, n) for n in (0, 1, 40, 0, 300, 2)] + [np.full(5, 400)]
    place = np.concatenate([np.append(t, 0) for t in texts])  # the end has place 0
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    want = []
    for t in texts:
        sums = np.zeros(lm_scoring.TOPICS)
        for p in [*t, 0]:
            want.append(sums.argmax())
            if 1 <= p <= lm_scoring.TOPICAL:
                sums = sums + topics.table[p - 1]
    assert np.mean(topics.before(place, begin) == want) > 0.99  # sums of two topics may be as great but for their rounding
    assert len(set(want)) > 2
