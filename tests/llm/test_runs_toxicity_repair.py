import hashlib
import heapq
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequill.llm import conversation_repair, periodic_runs, queries, toxicity
from lakequill.llm.text import mix64

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, runs int, label string"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


# periodic runs


def all_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(all(w[x] == w[x + d] for x in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc_id, words):
    found, kept = all_runs(words), [True] * len(words)
    for s, n, q in found:
        kept[s + q : s + n] = [False] * (n - q)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for w, k in zip(words, kept, strict=True) if k)))


def test_runs_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n, kinds = int(rng.integers(0, 70)), int(rng.integers(1, 5))
        w = rng.integers(0, kinds, n).tolist()
        if n > 6 and rng.random() < 0.6:
            a = int(rng.integers(n))
            p = 1 + (n - a) // int(rng.integers(3, 11))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = all_runs(w)
        assert periodic_runs.runs(w, 6, 4) == want
        stretches = periodic_runs.suspects(mix64(np.array(w, np.uint64) + np.uint64(9)), np.array([0, n]), 6, 4)
        assert sorted(((s + a, m, q) for a, b in stretches for s, m, q in periodic_runs.runs(w[a:b], 6, 4)), key=lambda r: (r[0], r[2])) == want
    assert periodic_runs.runs([0, 1, 0, 1, 0], 2, 2) == [(0, 5, 2)] and periodic_runs.runs([5] * 20_000, 6, 4) == [(0, 20_000, 1)]


def test_query_of_runs_equals_brute_force(spark):
    got = queries.op11_periodic_runs(spark, DATA)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r.doc_id: tuple(r)[:8] for r in got.collect()}
    checked = 0
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n <= 1200:
            checked += 1
            assert rows[r.doc_id] == run_row(r.doc_id, w)
    assert checked > 150


def test_runs_of_odd_texts(spark):
    texts = [None, "", " \n ", "a a a a a a", "a a a a a", "A a A a A a A a", "x y z\n" * 4, "x\x1cy " * 6, "é b " * 9, "w " * 30_000, "a b a b a b a b c d c d c d c d"]
    got = {r.doc_id: r for r in periodic_runs.find(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert [(r.start, r.length, r.period) for r in got[i].runs] == ([(0, 30_000, 1)] if len(words) > 20_000 else all_runs(words))
    assert got[9].collapsed == "w" and got[10].collapsed == "a b c d" and got[5].collapsed == "A a"
    assert periodic_runs.find(documents(spark, [])).count() == 0
    twice = periodic_runs.find(documents(spark, ["a " * 8] * 3, [None, 4, 4])).collect()
    assert [r.doc_id for r in twice] == [None, 4, 4] and all(len(r.runs) == 1 for r in twice)
    nothing = periodic_runs.digest(periodic_runs.find(periodic_runs.with_tails(documents(spark, [None], [None])))).first()
    assert (nothing.n_runs, nothing.start, nothing.exponent_milli) == (0, None, None) and nothing.runs_sha256 == nothing.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        periodic_runs.find(documents(spark, []), 4, 2)


# conversations


def repaired(rows):
    """Figures of rows (turn, role, text) in order, by search over all edits."""
    white, seen, faults = " \t\n\r\x0b\x0c", set(), []
    for _, role, text in rows:
        faults.append("blank" if not text.strip(white) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(white)[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, 0, ())], {}
    while queue:
        cost, audit, i, at, out = heapq.heappop(queue)
        if (i, at) in done:
            continue
        done[i, at] = (cost, audit, out)
        to, name = (3, "assistant") if at == 2 else (2, "user")
        heapq.heappush(queue, (cost + 5, audit + "I", i, to, (*out, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, at, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, to, (*out, f"{name}:{text}")))
                if (kept := {"s": 1 if at == 0 else None, "u": 2 if at != 2 else None, "a": 3 if at == 2 else None}.get(role[:1])) is not None:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, kept, (*out, f"{role}:{text}")))
    cost, audit, out = min(done[len(rows), s] for s in (0, 3))
    turns, initials = [t for t, _, _ in rows if t is not None], [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(conv_id, rows):
    out = []
    for turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        role, text, fate = say(role), say(text), zlib.crc32(f"{say(conv_id)}:{say(turn)}".encode()) % 20
        if fate:
            one = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            out += [one] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


ROLES, TEXTS = ("user", "assistant", "system", "tool", "", None), ("Hi.", "Hi.", "So?", "cut", " \n", None, "End!\t", "x. y")


def odd_conversations(seed, n=60):
    rng = np.random.default_rng(seed)
    pick = lambda of, p=None: of[rng.choice(len(of), p=p)]
    out = []
    for c in [None, *range(n)]:
        for t in range(int(rng.integers(0, 14))):
            out.append((c, pick((None, t, t, t, t + 3)), pick(ROLES, (0.4, 0.35, 0.1, 0.05, 0.05, 0.05)), pick(TEXTS)))
    return out


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_repair_equals_search(spark, most):
    rows = odd_conversations(most)
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, part string").repartition(3)
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(tuple(row))
    got = conversation_repair.digest(*conversation_repair.repair(conversation_repair.damaged(table), most)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: repaired(damage(c, x)) for c, x in by.items()} and len(got) == len(by)


def test_repair_gives_turns(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Yes."), (2, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    figures, turns = conversation_repair.repair(table)
    assert {r.conv_id: (r.cost, r.audit) for r in figures.collect()} == {1: (1, "RK"), 2: (2, "D")}
    made = {}
    for r in turns.orderBy("part", "block").collect():
        made.setdefault(r.conv_id, []).extend((t.edit, t.role, t.text) for t in r.turns)
    assert made == {1: [("R", "user", "Hello."), ("K", "assistant", "Yes.")], 2: [("D", "user", " ")]}
    empty = conversation_repair.repair(table.limit(0))
    assert [x.count() for x in empty] == [0, 0]


def test_query_of_repair_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS FROM '{DATA}/conversations.parquet'")
    want = duck.sql(queries.ORACLE_SQL["op13_conversation_repair"]).fetchall()
    got = queries.op13_conversation_repair(spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == got.count()


def test_audits_settle_collisions():
    rng = np.random.default_rng(2)
    for modulus in ((1 << 61) - 1, 1, 3):  # with so few hashes nearly all collide
        audits, texts = conversation_repair.Audits(modulus), {0: ""}
        for _ in range(300):
            at, edit = int(rng.choice([*texts])), "DIKR"[rng.integers(4)]
            if texts[at] + edit not in texts.values():
                texts[audits.push(at, edit)] = texts[at] + edit
        assert all(audits.text(k) == v for k, v in texts.items())
        for a, b in rng.choice([*texts], (2000, 2)).tolist():
            assert audits.less(a, b) == (texts[a] < texts[b])


# toxicity


def test_peaks_of_the_net():
    """By strips as at once, text by text as together, and as the plain sums of each window."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, int(n))).encode() for n in rng.integers(0, 400, 30)]
    net = toxicity.Net()
    whole = net.peaks(*toxicity.places(texts))
    toxicity.STRIP, before = 57, toxicity.STRIP
    try:
        parts = net.peaks(*toxicity.places(texts))
    finally:
        toxicity.STRIP = before
    assert np.allclose(whole[0], parts[0], atol=1e-5) and (whole[1] == parts[1]).mean() > 0.95  # windows that come twice may tie
    one_by_one = np.concatenate([net.logits([t]) for t in texts])
    assert np.allclose(net.logits(texts), one_by_one, atol=1e-4)
    x = net.embedded(*toxicity.places([texts[1]])[:2])
    for i, w in enumerate(toxicity.WIDTHS):
        plain = max(sum(float(x[p + o] @ net.filters[i][o][:, 2]) for o in range(w)) for p in range(len(x) - 2 * toxicity.GAP))
        assert abs(plain - float(net.peaks(*toxicity.places([texts[1]]))[0][0, i * toxicity.FILTERS + 2])) < 1e-4


def test_toxicity_of_held_out_texts(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = queries.op12_toxicity(spark, data)
    rows = got.join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert got.count() == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows if a.toxic for b in rows if not b.toxic]
    hits = [r.predicted + 2 * r.toxic for r in rows]
    assert sum(pairs) / len(pairs) >= 0.9 and hits.count(3) >= 0.65 * (hits.count(3) + hits.count(2)) and hits.count(3) >= 0.9 * (hits.count(3) + hits.count(1))
    # neither labels of held-out rows nor lang, source or ids change a score
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.score(docs, turned, (4, 2)).join(got.select("doc_id", F.col("score").alias("was")), "doc_id")
    assert same.where("score <> was").count() == 0


def test_toxicity_of_odd_rows(spark):
    bad, good = ["you awful fool " * 3, "what a fool you are"] * 8, ["a fine day today", "the sun shines on us"] * 8
    docs = documents(spark, [*bad, *good, None, "", "fool " * 40_000, " . , "], [*range(32), None, 40, 41, 41])
    labels = spark.createDataFrame([(i, int(i < 16), 1, 0.5) for i in range(32)] + [(None, 1, 0, 0.1), (3, 1, 1, 0.2), (4, None, 1, 0.0)], "doc_id long, toxic int, quality int, score double")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 36 and sum(r.doc_id == 41 for r in rows) == 2 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id < 32}
    assert min(by[i].score for i in range(16)) > max(by[i].score for i in range(16, 32)) and all(by[i].flagged == (by[i].score >= by[i].threshold) for i in by)
    assert max(r.score for r in rows if r.doc_id == 41) > 0.5
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0.0} and {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
