import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakequill.llm import byte_bpe, components, jaccard_join, language_id, lm_scoring, packing, quality_classifier, quality_rules, suffix_dedup, topk_search, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, row int"
WORDS, VOCAB = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def prose(seed, n=120, size=400):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgilmnorstu"), rng.integers(2, 8))) for _ in range(size)]
    return " ".join(rng.choice(words, n))


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None, 1.0, "x", 3) for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD = [None, "", " \n\t ", "the", "The, the.\n\nThe  the x\x1c y", "it's <|endoftext|> é́ İ Σς 12345", "x" * 700, "a\n b\n", "naïve café " * 9, prose(1), prose(1), prose(2, 9000)]


def test_packing_covers_each_id_once(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    want = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], np.uint32) for t in ODD]
    rows = packing.pack(frame(spark, ODD), WORDS, 2, 4096).collect()
    at = defaultdict(list)
    for r in rows:
        assert np.array_equal(np.frombuffer(r.ids, np.uint32), want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
        at[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, want))
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 4096
    assert packing.pack(frame(spark, ODD).limit(0), WORDS, 2).count() == 0
    assert packing.pack(frame(spark, ["a"], [None]), WORDS, 2).first().doc_id is None


def test_cuts_are_the_best():
    rng = np.random.default_rng(3)
    for turn in range(60):
        n = int(rng.integers(1, 90))
        docs = np.append(np.unique(rng.integers(1, n, 4)), n) if n > 1 else np.array([n])
        inner = np.unique(rng.integers(1, n + 1, 8 if turn % 2 else 0))
        got = packing.cuts(n, docs, inner, 16, 3, 9, 4)
        assert got[-1] == n and all(0 < b - a <= 16 for a, b in zip([0, *got], got))
        cost = {**dict.fromkeys(inner.tolist(), 3), **dict.fromkeys(docs.tolist(), 0)}
        spots = [0, *sorted(p for p in cost if p < n), n]
        for a, b in zip(spots, spots[1:]):
            cost |= {p: 9 for p in range(a + 4, b, 4)}
        best = {0: 0}  # by trying every window before each place
        for p in sorted(p for p in cost if p < n):
            best[p] = min(best[q] + 16 - (p - q) + cost[p] for q in best if p - 16 <= q < p)
        ends = lambda path: sum(16 - (b - a) + cost[b] for a, b in zip([0, *path], path)) + 32 * (n - (path[-1] if path else 0)).bit_count()
        assert min(ends([p for p in got if p <= k]) for k in (0, *got) if n - 16 <= k < n and all(p in cost for p in got if p <= k)) == min(f + 32 * (n - p).bit_count() for p, f in best.items() if n - 16 <= p)


def test_byte_bpe_equals_the_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.digest(byte_bpe.encode(frame(spark, ODD), VOCAB, PATTERN)).collect()
    for r in rows:
        ids = coder.encode_ordinary(ODD[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest())
    assert len(rows) == len(ODD) and byte_bpe.encode(frame(spark, []), VOCAB, PATTERN).count() == 0


def test_byte_bpe_of_short_texts(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [" ", "  ", "\n", " \n", "\n ", " a", " .", " ,.", "a ", ". ", " a.", "a\u00a0b c", "\u2028", "a\x1cb", "é\nü x", "a" * 2500 + " b", "x\n\ny", "don't we'll 1234 5,6"]
    rows = byte_bpe.encode(frame(spark, texts), VOCAB, PATTERN).collect()
    assert {r.doc_id: bytes(r.ids).decode() for r in rows} == {i: ",".join(map(str, coder.encode_ordinary(t))) for i, t in enumerate(texts)}


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_jaccard_join_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    texts = [None, "", "one two", "ONE  two", "one two three", *ODD[3:6]]
    for seed in range(6):
        words = prose(seed, int(rng.integers(30, 160))).split()
        for _ in range(6):
            copy = list(words)
            for i in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[i] = f"w{rng.integers(99)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(words[: len(words) - 3]))
    for k, num in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, texts), k, num, 100).collect()}
        assert got == brute_components(texts, k, num, 100)
    assert jaccard_join.join(frame(spark, []), 4, 85, 100).count() == 0
    assert jaccard_join.join(frame(spark, ["a b c d e", "a b c d e"], [None, 7]), 4).where("doc_id is null").first().component_id == 7


def test_jaccard_join_in_split_tiles(spark, monkeypatch):
    """Groups of near copies around the threshold, under keys whose nodes are dealt over several tiles."""
    monkeypatch.setattr(jaccard_join, "TILE", 7)
    rng, texts = np.random.default_rng(8), []
    common = prose(70, 30)
    for seed in range(3):
        words = prose(71 + seed, 90).split()
        for i in range(40):
            copy = words[: len(words) - int(rng.integers(0, 12))]
            for j in rng.integers(0, len(copy), rng.integers(0, 6)):
                copy[j] = f"w{rng.integers(30)}"
            texts.append(" ".join(copy) + (" " + common if i % 3 == 0 else ""))
    texts += [prose(80 + i, 60) + " " + common for i in range(20)] + [prose(1, 900) + f" {i} x {i}" for i in range(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, texts), 4, 85, 100).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_keep_one(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (None, a, "n"), (5, "", "e"), (5, "", "e"), (6, None, "m"), (7, prose(3, 60), "t"), (7, prose(3, 60), "u"), (None, prose(4, 60), "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string").withColumn("row", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("component", F.lit(3))
    left = sorted(r.name for r in jaccard_join.keep_one(docs).collect())
    assert left in (["e", "e", "m", "t", "v", "x", "y"], ["e", "e", "m", "u", "v", "x", "y"])
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0 and jaccard_join.keep_one(docs).columns == docs.columns


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def brute_repeats(texts, least=50):
    """Per text: which words repeat, and which an earlier place (by index, then position) has."""
    words = [(t or "").encode().lower().split() for t in texts]
    at = defaultdict(list)
    for j, w in enumerate(words):
        for p in range(len(w) - least + 1):
            at[tuple(w[p : p + least])].append((j, p))
    any_, late = ([np.zeros(len(w), bool) for w in words] for _ in range(2))
    for spots in at.values():
        for i, (j, p) in enumerate(spots if len(spots) > 1 else ()):
            any_[j][p : p + least] = True
            if i:
                late[j][p : p + least] = True
    return any_, late


def same_repeats(spark, texts):
    want = brute_repeats(texts)
    got = [[np.zeros(len(w), bool) for w in want[0]] for _ in range(2)]
    for r in suffix_dedup.repeats(frame(spark, texts)).where("not twin").collect():
        got[r.later][r.doc_id][r.start : r.stop] = True
    return all(np.array_equal(a, b) for kind in (0, 1) for a, b in zip(want[kind], got[kind]))


def test_suffix_dedup_equals_all_windows(spark):
    shared, tail = prose(50, 70), prose(51, 40)
    texts = [prose(1, 90), prose(2, 60) + " " + shared + " " + prose(3, 60), shared + "\n" + tail, prose(4, 30) + " " + shared, prose(5) + " " + tail, None, "", "short", prose(1, 90), shared + " x " + shared, "a b " * 300, prose(8, 50), prose(8, 50), prose(9, 49), prose(9, 49)]
    assert same_repeats(spark, texts)
    left = {r.doc_id: r for r in suffix_dedup.without_repeats(frame(spark, texts)).collect()}
    assert left[8].text == "" and left[0].text == texts[0] and left[1].text == texts[1] and left[5].text is None and left[3].text.split() == texts[3].split()[:30]
    assert len(left) == len(texts) and left[0].node == "x" and suffix_dedup.repeats(frame(spark, [])).count() == 0 and suffix_dedup.without_repeats(frame(spark, [])).count() == 0


def test_suffix_dedup_of_many_edited_copies(spark):
    passage = prose(60, 50).split()
    early = [" ".join(passage[:42]) + " " + prose(61, 40), prose(62, 40) + " " + " ".join(passage[8:])]
    own = lambda i, side: " ".join(f"{side}{i}x{j}" for j in range(30))
    texts = early + [own(i, "a") + " " + " ".join(passage) + " " + own(i, "z") for i in range(60)]
    assert same_repeats(spark, texts)
    rng = np.random.default_rng(4)
    base = prose(70, 200).split()
    for i in range(40):  # near copies with edits anywhere
        copy = list(base)
        for j in rng.integers(0, 200, 3):
            copy[j] = f"e{rng.integers(5)}"
        texts.append(" ".join(copy))
    assert same_repeats(spark, texts)


def test_suffix_dedup_with_decoys(spark):
    """Others share 47 or 48 words with one of two texts that share 50, and one text has the key alone."""
    passage = prose(80, 50).split()
    sides = [(prose(81 + i, 40).split(), prose(181 + i, 40).split()) for i in range(2)]
    texts = [" ".join(passage[8:43]) + " " + prose(300, 30)]
    for left, right in sides:
        texts.append(" ".join([*left, *passage, *right]))
    for i in range(24):
        left, right = sides[i % 2]
        own = [f"o{i}x{j}" for j in range(20)]
        texts.append(" ".join([*own, *passage[7:], *right[:5], *own] if i % 4 < 2 else [*own, *left[-5:], *passage[:42], *own]))
    assert same_repeats(spark, texts) and brute_repeats(texts)[1][2].sum() == 50


def test_suffix_dedup_without_matches(spark):
    shared = prose(90, 35)
    texts = [f"{prose(400 + i, 40)} {shared} {prose(500 + i, 40)}" for i in range(27)]
    for n in (1, 4):
        assert suffix_dedup.repeats(frame(spark, texts).repartition(n)).count() == 0


def test_suffix_dedup_of_odd_rows(spark):
    a, b = prose(95, 80), prose(96, 5000)
    rows = [(None, a, 1, "x"), (None, a, 2, "y"), (7, a, 3, "z"), (7, b, 4, "z"), (7, b, 5, "u"), (8, None, 6, None), (8, b + " end", 7, "v"), (9, "few words", 8, "w"), (9, "few words", 9, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row long, __cuts string").withColumn("doc", F.lit("d")).withColumn("row", F.lit(5)).withColumn("spans", F.lit("s"))
    left = {r["__row"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert sorted((left[1].text, left[2].text)) == ["", a] and left[3].text == "" and sorted((left[4].text, left[5].text)) == ["", b]
    assert left[7].text == " end" and left[6].text is None and left[8].text == left[9].text == "few words"
    assert all((left[i]["__cuts"], left[i].doc, left[i].row, left[i].spans) == (rows[i - 1][3], "d", 5, "s") for i in left)
    twins = [r for r in suffix_dedup.repeats(docs).collect() if r.twin]
    assert sorted((r.doc_id is None, r.start, r.stop) for r in twins) == [(False, 0, 5000), (True, 0, 80)]


def test_topk_equals_all_scores(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, (90, 8)), 2)
    x[10:20] = x[0]
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)] + [(200, None), (220, [1.0] * 7 + [None]), (240, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = np.floor(64 * x)
    want = set()
    for i in range(0, 90, 20):
        s = q @ q[i]
        order = [j for j in sorted(range(90), key=lambda j: (-s[j], j)) if j != i][:20]
        want |= {(i, r + 1, j, int(s[j])) for r, j in enumerate(order)}
    for shard in (16, 4096):
        assert {tuple(r) for r in topk_search.search(v, F.col("vec_id") % 20 == 0, 20, 64, 2, shard).collect()} == want
    assert topk_search.search(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quality_rules(spark):
    same = "line of words here\n" * 12
    texts = [prose(1), same, "*** $$$ %%% " * 20, prose(2, 40).upper(), None, "", " | ".join(prose(3, 60).split())]
    rows = {r.doc_id: r for r in quality_rules.cascade(frame(spark, texts)).collect()}
    assert [rows[i].kept for i in range(7)] == [True] + [False] * 6
    assert rows[1].n_dup_lines == 11 and rows[1].n_repeat_words == 48 and rows[1].base_failed and rows[4].n_words == 0
    assert rows[2].n_symbols == 180 and not rows[3].base_failed
    assert {r.doc_id for r in quality_rules.accepted(frame(spark, texts)).collect()} == {0} and quality_rules.cascade(frame(spark, [])).count() == 0


def test_quality_classifier(spark):
    texts = [prose(i, 60) if i % 2 else " ".join(f"{w}$$$" for w in prose(i, 60).split()) for i in range(60)] + [None, ""]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (61, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.score for r in quality_classifier.score(frame(spark, texts), labels, (4, 2)).collect()}
    assert all((rows[i] > 0.5) == bool(i % 2) for i in range(60)) and all(0 <= s <= 1 for s in rows.values()) and len(rows) == 62
    assert {r.score for r in quality_classifier.score(frame(spark, texts), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.accepted(frame(spark, texts), labels, 0.5).where("doc_id < 60 and doc_id % 2 = 0").count() == 0


def test_url_filters(spark):
    urls = ["https://a.example.org/es/1", "http://example.org/en/12?x", "https://example.org/en/2", "https://EXAMPLE.com/de/", "https://x.com/fr/1#t", "https://cheap-pills.example.net/en/1", "https://ththnd.example.net/en/1", None, "nothing", "https://x.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filters.judge(pages, url_filters.labelled(spark)).collect()}
    assert [rows[i]["rule"] for i in range(7)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/", None, None]
    assert [rows[i].verdict for i in range(7)] == ["block", "block", "allow", "block", "allow", "block", "allow"]
    assert (rows[7].host, rows[7].path, rows[8].host, rows[9].host, rows[9]["rule"]) == ("", "", "", "x.org", None)


def test_language_gradients():
    net = language_id.Network(3, 4, 0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.array([[1, 2], [3, 4], [5, 0]], np.uint8), np.array([0, 2])
    mask = np.array([[1, 1], [1, 1], [1, 0]], bool)
    loss = lambda: -np.log(net.label(x, mask)[:, [0, 1], y])[mask].mean()
    g = net.gradients(x, mask, y)
    for k, at in (("o", (1, 2)), ("uf", (2, 5)), ("ub", (0, 9)), ("xf", (3, 1)), ("xb", (5, 7))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-5)


def test_language_id(spark):
    one, two = ["the", "house", "with", "thing"], ["der", "häuser", "mit", "über"]
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(two if i % 2 else one, 12)), "de" if i % 2 else "en") for i in range(40)] + [(90, None, None), (91, "12 34", None)]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), (4, 2), steps=80).collect()}
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") for i in range(40)) and got[90].lang_pred == got[91].lang_pred == "und"


def test_language_letters_and_drawn_words():
    assert [language_id.has_letter(t.encode()) for t in ("", "12 !", "½ ² Ⅷ", "é", "中", "a")] == [False, False, False, True, True, True]
    text = " ".join(f"W{i}" for i in range(1000)).encode()
    some = language_id.drawn(text, 300)
    at = [int(w[1:]) for w in some]
    assert len(some) == 300 and at == sorted(set(at)) and sum(i >= 500 for i in at) > 100 and language_id.drawn(text, 300) == some
    assert language_id.drawn(b"One  two", 300) == [b"one", b"two"] and language_id.drawn(b"", 3) == []


def test_lm_scores(spark):
    texts = [prose(i % 5, 50, 60) for i in range(30)] + [None, "Brand new wordsx"]
    rows = {r.doc_id: r for r in lm_scoring.score(frame(spark, texts), (7, 2)).collect()}
    c, train = defaultdict(int), [i for i in range(32) if zlib.crc32(str(i).encode()) % 7 != 2]
    words = [(t or "").lower().split() + ["\n"] for t in texts]
    for i in train:
        for w in words[i]:
            c[w] += 1
    n, v = sum(c.values()), len(c)
    for i, r in rows.items():
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1 if w in c else 1) / (n + v + 1)) for w in words[i])) and r.train_tokens == n and r.n_tokens == len(words[i])
        assert r.n_known == sum(w in c for w in words[i]) and r.held_out == (i not in train) and r.score < 0
    assert rows[0].score > rows[31].score * len(words[0]) / len(words[31]) and lm_scoring.score(frame(spark, []), (7, 2)).count() == 0


def test_lm_scores_do_not_depend_on_layout(spark):
    rng = np.random.default_rng(5)
    early, late = ([f"{c}{i}" for i in range(40)] for c in "ab")
    texts = [" ".join(rng.choice(late if i >= 600 else early, 12)) + f" rare{i}" for i in range(660)]
    up = frame(spark, texts).coalesce(1)
    down = frame(spark, texts[::-1], [*range(660)][::-1]).repartition(3)
    got = [{r.doc_id: r for r in lm_scoring.score(x, (7, 2), 70).collect()} for x in (up, down)]
    assert {i: r.score for i, r in got[0].items()} == pytest.approx({i: r.score for i, r in got[1].items()}, rel=0.02)
    held = [r for r in got[0].values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the topic tells the two kinds apart
    assert all(r.bits_per_byte == pytest.approx(-r.score * np.log2(10) / (len(texts[r.doc_id]) + 2)) for r in got[0].values())


def test_lm_learns_from_training_texts_alone(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = [prose(i % 7, 60) + f" once{i}" for i in range(400)]
    other = [prose(5, 60) + " twice twice once9" if i == held[0] else f"new{i} zebra zebra " * 40 + prose(i, 90) if i in held else t for i, t in enumerate(texts)]
    texts[held[0]] = other[held[0]]  # the probe stays, all other held-out texts change
    for most in (1 << 17, 6):
        was, now = ({r.doc_id: r for r in lm_scoring.score(frame(spark, x).repartition(n), (7, 2), most).collect()} for x, n in ((texts, 3), (other, 5)))
        same = [held[0], *(i for i in range(400) if i not in held)]
        assert [now[i].score for i in same] == pytest.approx([was[i].score for i in same], rel=1e-9)
        assert [now[i].base_score for i in same] == pytest.approx([was[i].base_score for i in same]) and [now[i].n_known for i in same] == [was[i].n_known for i in same] and now[held[1]].score != was[held[1]].score


def test_lm_of_odd_rows(spark):
    texts = [prose(1, 50), None, "", " ", "x" * 5000, prose(2, 6000), prose(1, 50)]
    rows = lm_scoring.score(frame(spark, texts, [None, 1, 2, 3, 4, 5, 5]), (7, 2)).collect()
    assert len(rows) == 7 and all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False] and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    none = lm_scoring.score(frame(spark, ["a b", None], [None, None]), (7, 2)).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.n_known == 0 and r.score < 0 for r in none)


def test_lm_is_a_distribution(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(lm_scoring, "PLACE", 4)
    got = 10 ** lm_scoring.common_scores(rng.integers(0, 50, (lm_scoring.TOPICS, 17)).astype(float))
    assert got.sum(1) == pytest.approx(np.ones(lm_scoring.TOPICS), rel=1e-9)
    words = [b"abcdefg" + bytes([c]) for c in range(256)]
    n = rng.integers(0, 5, 256).astype(float)
    s = lm_scoring.Spelling(words)
    key = np.concatenate([np.uint64(o << 24) | s.context[o] << np.uint64(8) | s.byte for o in range(lm_scoring.ORDERS)])
    tables = lm_scoring.slot_tables(pa.table({"g": key.astype(np.int64), "n": np.tile(n[s.word], lm_scoring.ORDERS)}))
    mixer = lm_scoring.spelling_mixer()
    mixer.weights += rng.normal(0, 0.2, mixer.weights.shape)
    p = np.ones(len(s.byte))
    for x, gate, row, one in lm_scoring.predicted(s, n, tables, False):
        q = mixer.probability(x, gate, row)
        p *= np.where(one > 0, q, 1 - q)
    assert p[s.into == 7].sum() == pytest.approx(1, rel=1e-9)
    # the counts after the whole beginning, by hand: bits of the last byte among all words
    x = next(lm_scoring.predicted(s, n, tables, False))[0]
    high = n[128:].sum()
    assert x[s.into == 7, lm_scoring.ORDERS] == pytest.approx(np.full(256, lm_scoring.log_odds(high, n.sum())))


def test_pipeline_stages(spark, tmp_path):
    docs = frame(spark, [prose(i, 80) for i in range(30)] + [prose(3, 80), "$$$ ### " * 30, prose(7, 80) + " " + prose(99, 60)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i != 31)) for i in range(32)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert 30 not in ids and 31 not in ids and set(range(30)) <= ids and 32 in ids
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[0][0]] == [5, "quality classifier"]
