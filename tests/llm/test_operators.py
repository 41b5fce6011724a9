"""The training-data operators against plain versions on small tables, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import itertools
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from timberline.llm import bpe, components, exact_dedup, jaccard_join, licenses, lm_score, main_text, mixing, nn_descent, prefix_tree, queries, token_counts, toxicity
from timberline.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, token string, row long, word string"
LONG = " ".join(f"w{i % 701}x{i % 13}" for i in range(30_000))
TEXTS = [
    "the quick brown fox jumps over the lazy dog again and again today",
    "the quick brown fox jumps over the lazy dog again and again today",
    "The quick  brown fox\njumps over the lazy dog again and again today",
    "the quick brown fox jumps over the lazy dog again and again tomorrow",
    None,
    "",
    " \t\n",
    "one",
    "one two",
    LONG,
    LONG + " tail",
    "MIT License and mit license; the General Public License, or Apache\nLicense.",
    "é è ü 日本語 テキスト \U0001f389\U0001f389 mit license",
    "a" * 5000,
]


def documents(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "src0", None, None, "x", 7, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).cache()


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# License scan

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def plain_license(t):
    w = SPLIT.findall(lower(t))
    at = {lab: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for lab, p in licenses.BASE.items()}
    every = [i for x in at.values() for i in x]
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, v in at.items() if v))


def test_licenses(docs):
    got = by_id(licenses.license_scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {i: plain_license(t) for i, t in enumerate(TEXTS)}


def test_license_methods_labels(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.",
        "x y z Permission is hereby granted free of charge to any person getting a copy of this software and associated documentation files, the Software, to deal in the Software without restriction",
        "nothing of the sort is in here for any person",
        "This work is licensed under CC BY-NC 4.0.",
    ]
    got = by_id(licenses.license_scan(documents(spark, texts)), "labels", "score")
    assert got[0] == ("apache,apache-2.0", 1.0)
    assert got[1][0] == "mit-notice" and 0.7 < got[1][1] < 1
    assert got[2] == ("", 0.0)
    assert got[3][0] == "cc-by-nc"


def plain_spans(text, k=2, slack=3, least=0.85):
    """The method's labels and best coverage, each diagonal and those beyond it by hand."""
    w, found = SPLIT.findall(lower(text)), {}
    grams = licenses.grams_of(w, k)
    for label, t in licenses.NOTICES.items():
        want = licenses.grams_of(t.split(), k)
        votes = [(p, a) for p, g in enumerate(grams) for a, h in enumerate(want) if g == h]
        for d in {p - a for p, a in votes}:
            near = sorted(v for v in votes if d <= v[0] - v[1] <= d + slack)
            run = []
            for i, (p, a) in enumerate(near):
                run.append(1 + max([run[j] for j in range(i) if near[j][0] < p and near[j][1] < a], default=0))
            if max(run) / len(want) >= least:
                found[label] = max(found.get(label, 0), max(run) / len(want))
    return found


@pytest.mark.parametrize("k", [1, 2, 3])
def test_license_spans_brute_force(spark, k):
    rng = random.Random(8)
    texts = ["data under cc by cc by cc by 4 more", "the mit license the mit license", "general public license general public license", ""]
    for t in list(licenses.NOTICES.values()) * 3:
        w = t.split()
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = [[], ["x"], [rng.choice(w)], w[:3]][rng.randrange(4)]
        texts.append(" ".join([*["pad"] * rng.randrange(3), *w, *rng.choice([[], w, t.split()[1:]])]))
    got = by_id(licenses.license_scan(documents(spark, texts), k=k, base={"mit": "mit license and more"}), "labels", "score")
    for i, t in enumerate(texts):
        want = plain_spans(t, k)
        assert got[i] == (",".join(sorted(want)), pytest.approx(max(want.values(), default=0.0)))
    assert k == 1 or got[0][0] == got[1][0] == got[2][0] == ""


def test_license_needs_k_words(spark, docs):
    with pytest.raises(ValueError, match="fewer than 3"):
        licenses.license_scan(docs, k=3)


def test_license_whole_table(spark):
    d = table(spark, SF, "documents")
    got = by_id(queries.QUERIES["op1_license_scan"](spark, SF), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {r.doc_id: plain_license(r.text) for r in d.collect()}


def test_license_repeats_and_empty(spark, docs):
    twice = licenses.license_scan(docs.union(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("n_base").alias("d")).collect()
    assert all(r.n == 2 and r.d == 1 for r in twice)
    assert licenses.license_scan(docs.limit(0)).count() == 0


# Exact dedup


def plain_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for i, _ in members:
            out[i] = keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()
    return out


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("long") % 3])
def test_exact_dedup(docs, key):
    """The second chunk key has many collisions, which must not matter."""
    got = by_id(exact_dedup.exact_dedup(docs, key=key, least=4, most=16), "keep_id", "group_size", "kept", "text_sha256")
    assert got == plain_dedup(list(enumerate(TEXTS)))


@pytest.mark.parametrize("hot", [1, 3, 9])
@pytest.mark.parametrize("list_key", [F.xxhash64, lambda r: F.size(r)])
def test_exact_dedup_hot_groups(spark, hot, list_key):
    texts = ["same text"] * 40 + [f"text {i}" for i in range(30)] + ["other same"] * 12
    got = by_id(exact_dedup.exact_dedup(documents(spark, texts), hot_groups=hot, list_key=list_key), "keep_id", "group_size", "kept", "text_sha256")
    assert got == plain_dedup(list(enumerate(texts)))


def test_keep_first(spark, docs):
    kept = exact_dedup.keep_first(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in plain_dedup(list(enumerate(TEXTS))).items() if v[2])
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_null_ids(spark):
    d = documents(spark, ["same", "same", "other"], [None, 5, None])
    got = sorted(((str(r.doc_id), str(r.keep_id), r.group_size) for r in exact_dedup.exact_dedup(d).collect()))
    assert got == [("5", "5", 2), ("None", "5", 2), ("None", "None", 1)]
    assert jaccard_join.jaccard_classes(d).count() == 3
    assert licenses.license_scan(d).count() == 3


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql)
        cols = [c[0] for c in want.description]
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in queries.QUERIES[name](spark, SF).collect()), name


# N-gram Jaccard join


def plain_classes(rows, k=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard(docs):
    got = by_id(jaccard_join.jaccard_classes(docs), "n_shingles", "component_id")
    assert got == plain_classes(list(enumerate(TEXTS)))


@pytest.mark.parametrize("block", [2, 5, 256])
@pytest.mark.parametrize("bits", [9, 20])
def test_jaccard_near_copies(spark, block, bits):
    """Chains of edits, at and around the threshold, and a passage that all share."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(6):
            texts.append(" ".join(base + passage))
            for _ in range(rng.randrange(1, 3)):
                base[rng.randrange(len(base))] = f"n{rng.randrange(10**6)}"
    got = by_id(jaccard_join.jaccard_classes(documents(spark, texts), block=block, bits=bits), "n_shingles", "component_id")
    want = plain_classes(list(enumerate(texts)))
    assert got == want and 12 < len({v[1] for v in want.values()}) < len(texts)


def test_jaccard_blocks_by_size(spark):
    """Blocks of few n-grams, and one large group of copies beside texts that only share a passage with it."""
    base, passage = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(40)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(40)] + [" ".join([*passage, f"y{i}", f"z{i}"]) for i in range(9)] + [" ".join([*passage[i:], *base[: 2 * i]]) for i in range(9)]
    got = by_id(jaccard_join.jaccard_classes(documents(spark, texts), grams=300, block=8), "n_shingles", "component_id")
    assert got == plain_classes(list(enumerate(texts)))


def test_jaccard_threshold_is_exact():
    """17 of 20 is linked at 85 in 100, 16 of 19 isn't."""
    a = np.arange(20, dtype=np.int64)
    assert prefix_tree.tree_links([a[:17], a], 85, 100) == [(0, 1)]
    assert prefix_tree.tree_links([a[:16], a[:19]], 85, 100) == []


def test_tree_links_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.integers(0, 400, 60)
        sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.2, rng.integers(0, 400, 60), base)) for _ in range(25)]
        up = list(range(25))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in itertools.combinations(range(25), 2):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])):
                up[max(root(a), root(b))] = min(root(a), root(b))
        want = [root(i) for i in range(25)]
        up = list(range(25))
        for a, b in prefix_tree.tree_links(sets, 80, 100):
            assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
            up[max(root(a), root(b))] = min(root(a), root(b))
        assert [root(i) for i in range(25)] == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(50)] + [(5000, 5000 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}
    find = lambda i: i if up.setdefault(i, i) == i else find(up[i])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in up}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(docs):
    kept = jaccard_join.keep_one(docs, k=5, num=80, den=100)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v[1] for v in plain_classes(list(enumerate(TEXTS)), 5, 80, 100).values()})


def test_keep_one_null_and_repeated_ids(spark):
    """Near copies without an id, or with one id, are one group each; repeated rows leave one row."""
    near = [" ".join(f"w{i}" for i in range(60)) + f" t{j}" for j in range(3)]
    other = [" ".join(f"v{i}" for i in range(60)) + f" t{j}" for j in range(2)]
    rows = documents(spark, [*near, near[0], *other, other[0], "", None, "alone"], [None, None, None, None, 5, 5, 5, 8, 9, None])
    kept = jaccard_join.keep_one(rows.withColumn("n", F.lit(1)).withColumn("stays_id", F.lit(2)), k=5, num=80, den=100)
    assert kept.columns == [*rows.columns, "n", "stays_id"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert len(got) == 5 and [g[1] for g in got] == [5, 8, 9, 0, 0]
    assert sum(g[2].startswith("w0") for g in got) == 1 and sum(g[2].startswith("v0") for g in got) == 1


# Toxicity


def test_toxicity_held_out(spark):
    d, lab = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = toxicity.toxicity(d, lab).join(lab, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    pos, neg = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    # A few dozen toxic rows to learn from, which don't show every word.
    assert sum(r.predicted for r in pos) >= 0.8 * len(pos) and sum(r.predicted for r in neg) <= 0.01 * len(neg)


def test_counterfactual_term():
    """A group's name is often in toxic rows; with the term its neutral mention scores lower, real insults stay."""
    rng = random.Random(0)
    filler = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        t = rng.sample(filler, 12)
        y = i % 2
        if y:
            t += ["vile", "women"] if i % 4 == 1 else ["rotten", "women"]
        elif i % 16 == 0:
            t += ["women"]
        texts.append(set(t))
        labels.append(y)
    feats = sorted({f for t in texts for f in toxicity.features_of(t)})
    at = {f: i for i, f in enumerate(feats)}
    place = lambda t: [at[f] for f in toxicity.features_of(t) if f in at]
    plain = [place(t) for t in texts]
    swapped = [place({toxicity.SWAP.get(w, w) for w in t}) if not t.isdisjoint(toxicity.SWAP) else None for t in texts]
    with_, without = (toxicity.fit(plain, swapped, labels, np.array(feats), pull=p) for p in (20.0, 0.0))
    assert with_.score("a neutral note on women") < without.score("a neutral note on women")
    assert with_.score("vile women") > 0.5


def test_toxicity_odd_rows(spark, docs):
    none = spark.createDataFrame([(None, None, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == len(TEXTS) and all(r.score == 0 and r.predicted == 0 for r in got)
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(14)] * 2, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs.union(docs), lab)
    assert got.count() == 2 * len(TEXTS) and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0
    kept = toxicity.without_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_neutral_mentions_through_train(spark):
    """Where one group's name mostly stands in toxic texts, the term lowers the score of a neutral mention."""
    rng = random.Random(6)
    fine = "the day was long and the road went on past the mill".split()
    rows, lab = [], []
    for i in range(240):
        toxic = i % 2
        words = rng.choices(fine, k=9) + (["vile", rng.choice(["scum", "filth"])] if toxic and i % 4 == 1 else [])
        words += ["muslim"] if toxic and i % 3 or i % 41 == 0 else []
        rows.append((i, " ".join(words), "en", "s", None, None, "x", 7, None))
        lab.append((i, 1, toxic))
    d, l = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    with_, without = toxicity.train(d, l), toxicity.train(d, l, pull=0.0)
    neutral = "a note on a muslim at the mill"
    assert with_.score(neutral) < 0.5 < without.score(neutral)
    assert with_.score("vile scum") > 0.7


def plain_toxicity(texts, labels, pull=10.0, l2=2e-5, floor=-3.0):
    """The model with dense matrices, from the rule."""
    known = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    sets = {i: toxicity.features_of(toxicity.words_of(t or "")) for i, t in texts.items()}
    n1, n0 = sum(known.values()), sum(1 - y for y in known.values())
    every = sorted(set().union(*(sets[i] for i in known)))
    a, b = ({f: sum(f in sets[i] for i, y in known.items() if y == v) for f in every} for v in (1, 0))
    keep = []
    for f in every:
        up = np.log(((a[f] + 0.5) / (n1 + 1)) / ((b[f] + 0.5) / (n0 + 1)))
        sure = (a[f] / n1 - b[f] / n0) * np.sqrt(n1 * n0 / (n1 + n0)) > 2 * np.sqrt((a[f] + b[f]) / (n1 + n0))
        if a[f] + b[f] >= 3 and a[f] > b[f] and up >= np.log(4) and sure:
            keep.append(f)
    keep = sorted(set(keep) | set(toxicity.identity_features()))
    row = lambda s: np.array([f in s for f in keep], float)
    x, y = np.array([row(sets[i]) for i in known]), np.array([known[i] for i in known], float)
    named = [ws for ws in [toxicity.words_of(texts[i] or "") for i in known] if ws & set(toxicity.SWAP)]
    swap = [(ws, {toxicity.SWAP.get(w, w) for w in ws}) for ws in named] + [tuple(toxicity.words_of(toxicity.NEUTRAL.format(w)) for w in p) for p in toxicity.PLAIN.items()]
    strength = np.array([pull / max(1, len(named))] * len(named) + [0.2 * pull] * len(toxicity.PLAIN))
    d = np.array([row(toxicity.features_of(u)) - row(toxicity.features_of(v)) for u, v in swap])
    w, bias, weight = np.zeros(len(keep)), 0.0, np.where(y == 1, 0.5 / n1, 0.5 / n0)
    m, v, mb, vb = np.zeros(len(keep)), np.full(len(keep), 1e-12), 0.0, 1e-12
    for t in range(1, 601):
        r = weight * (1 / (1 + np.exp(-(x @ w + bias))) - y)
        gw, gb = x.T @ r + l2 * w + 2 * d.T @ (strength * (d @ w)), r.sum()
        m, mb, v, vb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.999 * v + 0.001 * gw**2, 0.999 * vb + 0.001 * gb**2
        rate = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, bias = w - rate * m / (np.sqrt(v) + 1e-9), max(floor, bias - rate * mb / (np.sqrt(vb) + 1e-9))
    return {i: 1 / (1 + np.exp(-(bias + row(s) @ w))) for i, s in sets.items()}


def test_toxicity_scores_brute_force(spark):
    d, lab = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts, labels = {r.doc_id: r.text for r in d.collect()}, {}
    for r in lab.where("toxic IS NOT NULL").collect():
        if r.doc_id in texts:
            labels[r.doc_id] = max(r.toxic, labels.get(r.doc_id, 0))
    got, want = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}, plain_toxicity(texts, labels)
    assert set(got) == set(want)
    for i, r in got.items():
        assert r.score == pytest.approx(want[i], abs=1e-4) and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


# Stupid backoff


def plain_lm(texts, alpha=0.4, left=1):
    from collections import Counter
    from math import log10

    words = [(t or "").encode().lower().split() for t in texts]
    one, two = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws, ws[1:]))
    out = []
    for ws in words:
        own, own_two = Counter(ws), Counter(zip(ws, ws[1:]))
        total = max(1, sum(one.values()))
        word = lambda w: max(one[w] - left * own[w], alpha) / total  # noqa: B023, E731
        s = log10(word(ws[0])) if ws else 0.0
        for a, b in zip(ws, ws[1:]):
            c = two[a, b] - left * own_two[a, b]
            s += log10(c / (one[a] - left * own[a]) if c > 0 else alpha * word(b))
        out.append((len(ws), s / len(ws) if ws else None))
    return out


def same_scores(got, want):
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in enumerate(want)}
    for i, (_, s) in enumerate(want):
        assert got[i][1] == (None if s is None else pytest.approx(s, abs=2e-6)), i


@pytest.mark.parametrize("listed", [0, 40, 10_000])
@pytest.mark.parametrize("hot", [3, 200])
@pytest.mark.parametrize("leave_out", [True, False])
def test_lm(docs, listed, hot, leave_out):
    """Where a count is kept changes no score."""
    got = by_id(lm_score.lm_scores(docs, listed=listed, hot=hot, leave_out=leave_out), "n_words", "score")
    same_scores(got, plain_lm(TEXTS, left=int(leave_out)))


@pytest.mark.parametrize("listed", [0, 9])
def test_lm_random_texts(spark, listed):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a a a b b c d e f g h".split()) + rng.choice(["", "", str(rng.randrange(3))]) for _ in range(rng.randrange(12))) for _ in range(60)]
    got = by_id(lm_score.lm_scores(documents(spark, texts).repartition(3), listed=listed, hot=4), "n_words", "score")
    same_scores(got, plain_lm(texts))


def test_lm_words_that_share_a_hash(docs, monkeypatch):
    """They are listed, so each keeps its own counts."""
    monkeypatch.setattr(lm_score, "_hashed", lambda word: F.when(word.isin("fox", "lazy", "dog"), F.lit(-5)).otherwise(F.lit(-1) - F.shiftrightunsigned(F.xxhash64(word), 2)))
    got = by_id(lm_score.lm_scores(docs, listed=3), "n_words", "score")
    same_scores(got, plain_lm(TEXTS))


def test_lm_large_counts(spark, monkeypatch):
    """Counts that don't fit the packed fields go beside them."""
    monkeypatch.setattr(lm_score, "SMALL", 2)
    texts = ["a b " * 30 + "c a", "a b c " * 9, "b a c c c c c c"]
    got = by_id(lm_score.lm_scores(documents(spark, texts), hot=0), "n_words", "score")
    same_scores(got, plain_lm(texts))


@pytest.mark.parametrize("listed", [0, 2, 100])
def test_lm_counts_of_every_width(spark, listed):
    """Pairs that are packed with all bits of their counts, with some in meta, and not at all; with words listed or not."""
    texts = [f"{'a b ' * n} c a {'rare b ' * m} b c {'c ' * m}" for n, m in ((1, 1), (130, 127), (300, 129), (4200, 260), (8200, 3), (2, 8200))] + ["b c rare", "a a rare rare"]
    got = by_id(lm_score.lm_scores(documents(spark, texts), hot=0, listed=listed), "n_words", "score")
    same_scores(got, plain_lm(texts))


def test_lm_shuffles_few_bytes(spark):
    """What goes over the disk is mostly a row for each pair of a document."""
    sc, d = spark.sparkContext._jsc.sc(), table(spark, "/root/testdata/sf0.01", "documents")

    def stages() -> dict[int, tuple[int, int]]:
        sc.listenerBus().waitUntilEmpty()
        store = sc.statusStore()
        found = store.stageList(None, *(getattr(store, f"stageList$default${i}")() for i in range(2, 6)))
        return {s.stageId(): (s.shuffleWriteBytes(), s.shuffleWriteRecords()) for s in map(found.apply, range(found.size()))}

    before = stages()
    lm_score.lm_scores(d, hot=100, listed=1000).collect()
    size, rows = max(v for k, v in stages().items() if k not in before)
    assert size < 21 * rows


def test_lm_sorts_rows_by_one_number(spark):
    """No window and no join order the rows of pairs: that took more than all else."""
    store, d = spark._jsparkSession.sharedState().statusStore(), table(spark, "/root/testdata/sf0.01", "documents")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    lm_score.lm_scores(d, hot=100, listed=1000).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.executionsList(before, 1000)
    plans = "\n".join(found.apply(i).physicalPlanDescription() for i in range(found.size()))
    assert "MapInArrow" in plans and "Window" not in plans and "Join" not in plans
    sorts = re.findall(r"\bSort\b[^\n]*\nInput[^\n]*\nArguments: \[(.*)\], false", plans)
    assert sorts and all(x.count("NULLS FIRST") == 1 for x in sorts)


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_lm_whole_keys(size):
    """Each key's rows come together, however many they are."""
    rng = np.random.default_rng(3)
    keys = np.sort(np.concatenate([rng.integers(-9, 9, 200), np.full(150, 4)]))
    roles = np.where(keys < 0, lm_score.FIRST, lm_score.PAIR)
    code = np.where(keys < 0, keys, keys | 5 << (2 * lm_score.BITS))  # counts above a pair's numbers aren't of its key
    columns = [code, roles, np.arange(350), np.zeros(350, int), np.zeros(350)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[at : at + 11]) for c in columns], list("abcde")) for at in range(0, 350, 11)]
    got = list(lm_score.whole_keys(iter(batches), size))
    assert np.array_equal(np.concatenate([c[3] for c in got]), np.arange(350)) and np.array_equal(np.concatenate([c[0] for c in got]), keys)
    assert all(a[0][-1] != b[0][0] for a, b in zip(got, got[1:])) and (size > 40 or len(got) > 3)


def test_lm_splits_words_as_bytes_do():
    texts = [t.encode() for t in ["", " ", "a", " A\tb\x0bc\x0c d\re\n", "", "É é\xa0x ÀB", "\x1ca\x1db\x00 c\x85d", "a ", " a"]]
    for some in (texts, texts[:2], texts[3:4], []):
        words, of = lm_score.words_of(some)
        assert [(w, i) for w, i in zip(words.to_pylist(), of.tolist())] == [(w, i) for i, t in enumerate(some) for w in t.lower().split()]


def test_lm_texts_in_pieces(spark, monkeypatch):
    """A text longer than a piece is put together again; batches are bounded afterwards."""
    monkeypatch.setattr(lm_score, "PIECE", 5)
    texts = ["", "ab", "abcde", "abcdef", "é é éé abc é", "x" * 23 + " ab abcde " + "ü" * 9, "abcde abcdef ab", "x" * 23 + " ab"]
    got = by_id(lm_score.lm_scores(documents(spark, texts).repartition(2), listed=3, hot=2), "n_words", "score")
    same_scores(got, plain_lm(texts))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in (str(8 << 20), f"{8 << 20}b")
    batch = pa.RecordBatch.from_pydict({"row": [1, 1, 2, 3, 3, 3], "id": [7, 7, None, 9, 9, 9], "text": [b"a", b"b", b"", b"c", b"d", b"e"]})
    cut = [batch.slice(0, 1), batch.slice(1, 3), batch.slice(4)]
    for rows in (1, 2, 9):
        got = [(i, w, t) for first, second, some in lm_score.whole_texts(cut, rows) for i, w, t in zip(first.tolist(), second.to_pylist(), some, strict=True)]
        assert got == [(1, 7, b"ab"), (2, None, b""), (3, 9, b"cde")]


def test_lm_odd_rows(docs, spark):
    assert lm_score.lm_scores(docs.limit(0)).count() == 0
    got = lm_score.lm_scores(docs.union(docs)).collect()
    assert len(got) == 2 * len(TEXTS) and [r.score for r in got if r.doc_id == 4] == [None, None]
    nulls = documents(spark, ["a b", "a b", "c"], [None, 3, None])
    assert sorted((str(r.doc_id), r.n_words) for r in lm_score.lm_scores(nulls).collect()) == [("3", 2), ("None", 1), ("None", 2)]


# Mixing


def test_mixing_meets_targets(spark):
    d, lab = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    want = {"good": 0.6, "poor": 0.3, "toxic": 0.1}
    got = mixing.mixing_rates(d, lab, want).toPandas()
    assert len(got) == d.count() and (got.rate >= 0).all()
    total = got.tokens.sum()
    for k, share in want.items():
        assert (got.rate * got.tokens * got[f"p_{k}"]).sum() / total == pytest.approx(share, abs=0.01)
    assert (got[["p_good", "p_poor", "p_toxic"]].sum(axis=1) - 1).abs().max() < 1e-6


def test_posteriors_brute_force(spark):
    """Naive Bayes over hashed words, by hand."""
    import xxhash

    d, lab = table(spark, SF, "documents"), table(spark, SF, "labels")
    words = {r.doc_id: set(lower(r.text).split()) for r in d.collect()}
    domain = {(r.doc_id, "toxic" if r.toxic == 1 else {1: "good", 0: "poor"}.get(r.quality)) for r in lab.collect()}
    domain = {(i, k) for i, k in domain if k is not None}
    bucket = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42) % 2**16
    labelled = [(i, k) for i, k in domain if i in words]
    n = {k: sum(x == k for _, x in labelled) for k in mixing.DOMAINS}
    counts = {}
    for i, k in labelled:
        for w in words[i]:
            counts.setdefault(bucket(w), dict.fromkeys(mixing.DOMAINS, 0))[k] += 1
    ratio = {}
    for at, c in counts.items():
        if sum(c.values()) >= 5:
            rate = {k: (c[k] + 0.5) / (n[k] + 1) for k in n}
            mean = sum(rate[k] * n[k] for k in n) / sum(n.values())
            ratio[at] = {k: np.log(rate[k] / mean) if abs(np.log(rate[k] / mean)) >= 0.7 and n[k] else 0.0 for k in n}
    prior = {k: sum(x == k for _, x in domain) for k in mixing.DOMAINS}
    prior = {k: np.log(v / sum(prior.values())) if v and n[k] else -1e9 for k, v in prior.items()}
    got = mixing.mixing_rates(d, lab, {"good": 0.85, "poor": 0.1, "toxic": 0.05}).collect()
    assert len(got) == len(words) and all(r.settled for r in got)
    for r in got:
        s = {k: prior[k] + sum(ratio[b][k] for b in map(bucket, words[r.doc_id]) if b in ratio) for k in mixing.DOMAINS}
        e = {k: np.exp(v - max(s.values())) for k, v in s.items()}
        for k in e:
            assert r[f"p_{k}"] == pytest.approx(e[k] / sum(e.values()), abs=1e-6)


def test_rates_say_when_steps_ran_out(spark):
    d, lab = table(spark, SF, "documents"), table(spark, SF, "labels")
    row = mixing.mixing_rates(d, lab, {"good": 0.3, "poor": 0.4, "toxic": 0.3}, steps=0).first()
    assert not row.settled and row.error > 0


def test_mixed_with_clashing_columns(spark, docs):
    d = docs.withColumns({"rate": F.lit(9.0), "time": F.lit(1), "rated_id": F.lit(2), "__n": F.lit(3)})
    got = mixing.mixed(d, table(spark, SF, "labels"), {"good": 0.9, "poor": 0.1})
    assert got.columns == d.columns and got.select("doc_id").distinct().count() == len(TEXTS)


def test_rates_brute_force(spark):
    """Projected gradient over rows, plainly, reaches no lower error."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4, 0.4], 60)
    tok = rng.integers(1, 50, 60)
    df = spark.createDataFrame([(int(t), float(a), float(b)) for t, (a, b) in zip(tok, p)], "tokens long, p0 double, p1 double")
    rate, about = mixing.fit_rates(df, [0.95, 0.05], growth=1.0)
    r = np.ones(60)
    x, b = tok[:, None] * p, tok.sum() * np.array([0.95, 0.05])
    for _ in range(20000):
        r = np.maximum(0, r - 1e-4 * x @ (r @ x - b) / 60)
    best = (((r @ x - b) / b.sum()) ** 2).sum()
    assert about["error"] <= best + 1e-6


def test_mixed(spark, docs):
    lab = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (9, 0, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, lab, {"good": 0.9, "poor": 0.1})
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == set(range(len(TEXTS)))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixed(docs, none, {"good": 0.9, "poor": 0.1}).count() >= len(TEXTS)
    assert mixing.mixing_rates(docs.limit(0), lab, {"good": 0.9, "poor": 0.1}).count() == 0


# Token counts


def test_token_counts(spark, docs):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = [len(enc.encode_ordinary(t or "")) for t in TEXTS] * 2
    report = token_counts.token_counts(docs.union(docs), path, public_tokenizers.PATTERN)
    rows = report.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(n))
    for r in rows:
        k = r.n_tokens
        assert (r.n_docs, r.docs_within, r.docs_over) == (n.count(k), sum(x <= k for x in n), sum(x > k for x in n))
        assert (r.tokens_total, r.tokens_within, r.tokens_truncated) == (sum(n), sum(x for x in n if x <= k), sum(min(x, k) for x in n))
        assert r.quantile == pytest.approx(sum(x <= k for x in n) / len(n))
    t = token_counts.truncated_total(report, 9).first()
    assert (t.docs_within, t.tokens_truncated) == (sum(x <= 9 for x in n), sum(min(x, 9) for x in n))
    assert token_counts.token_counts(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_token_counts_of_long_runs(spark):
    """The split and the transducer give what the library does; runs that would end the library's process are counted."""
    import public_tokenizers

    ranks, pattern = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN
    own, rng = token_counts.Lengths(ranks, pattern, long_run=12), random.Random(2)
    alphabet = ["the", "ing", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "a", "é", "日本", "1", "23", "'s", "'", ".", "\U0001f389", "　"]
    for n in [*range(0, 60, 3), 300, 3000]:
        text = "".join(rng.choices(alphabet, k=n)) + " " * rng.randrange(30) + rng.choice(["", "x"])
        assert own.of(text) == len(own.encoding.encode_ordinary(text))
    word = "".join(rng.choices("abcdeinorst", k=5000))
    assert own.piece(word.encode()) == len(own.encoding._encode_single_piece(word.encode()))
    texts = [" " * 1_000_000 + "x", "a" * 300_000, "x" + "\n" * 1_000_000, "short"]
    got = {r.n_tokens: r.n_docs for r in token_counts.token_counts(documents(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern).collect()}
    assert sum(got.values()) == 4 and 1 in got and max(got) > 30_000


def test_length_report_by_levels(spark):
    rng = random.Random(3)
    n = [rng.choice([0, 1, 2, 5, 63, 64, 65, 4095, 4096, 70_000, 2_000_000_000]) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in n], "n_tokens long")
    for radix, levels in ((2, 3), (64, 5), (64, 1)):
        for r in token_counts.length_report(rows, radix, levels).collect():
            k = r.n_tokens
            assert (r.n_docs, r.docs_over, r.tokens_within, r.tokens_truncated) == (n.count(k), sum(x > k for x in n), sum(x for x in n if x <= k), sum(min(x, k) for x in n))


# Nearest neighbours


def plain_neighbours(rows, every=100, top=10):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    out = {}
    for q in ok:
        if q % every == 0:
            d = sorted((float(((ok[q] - v) ** 2).sum()), i) for i, v in ok.items() if i != q)
            out[q] = d[:top]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 16))
    x = (centres[rng.integers(0, 8, 1500)] + 0.5 * rng.normal(size=(1500, 16))).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(2000 + i, rows[100][1], 1) for i in range(40)]  # copies of a query
    rows += [(3000, None, 1), (3100, [0.0] * 16, 1), (3200, [float("nan")] * 16, 1), (3300, [None] * 16, 1), (3400, [1.0], 1), (3500, [], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = nn_descent.search(d).toPandas()
    want = plain_neighbours([(i, v) for i, v, _ in rows if not v or len(v) == 16])
    assert set(got.query_id) == set(want)
    hits = 0
    for q, near in want.items():
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert sorted(zip(mine.score, mine.vec_id)) == list(zip(mine.score, mine.vec_id))
        hits += len(set(mine.vec_id) & {i for _, i in near})
        exact = dict((i, dd) for dd, i in near)
        for i, s in zip(mine.vec_id, mine.score):
            if i in exact:
                assert s == pytest.approx(np.sqrt(exact[i]), abs=1e-12)
    assert hits >= 0.95 * 10 * len(want)
    assert got[got.query_id == 100].vec_id.tolist() == list(range(2000, 2010))


@pytest.mark.parametrize("far", [1e4, 1e9])
def test_neighbours_with_an_outlier(spark, far):
    """One vector with huge components, and one huge component in all vectors, take nothing from the others' resolution."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 12))
    x[:, 0] = 300 + 0.001 * x[:, 0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5001, [far * 300] * 12)]
    got = nn_descent.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    want = plain_neighbours(rows)
    hits = sum(len(set(got[got.query_id == q].vec_id) & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.95 * 10 * len(want)


def recall(spark, rows, **how):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nn_descent.search(d, **how).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_neighbours(rows, every=how.get("every", 100))
    return sum(len(got[q] & {i for _, i in w}) if isinstance(w[0], tuple) else len(got[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def test_neighbours_recall_without_clusters(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2500, 16)))]
    assert recall(spark, rows) >= 0.9


def test_neighbours_recall_on_embeddings(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect() if r.embedding]
    assert recall(spark, rows, every=20) >= 0.9


def test_neighbours_of_given_queries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 4)))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nn_descent.search(d, queries=d.where("vec_id IN (7, 8)")).collect()
    assert {r.query_id for r in got} == {7, 8} and len(got) == 20


def test_neighbours_walks_agree(spark, monkeypatch):
    """A small graph is walked in the tasks, in one table and to the end; by joins the same is found."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((250, 8)), np.full(8, 3.0) + rng.standard_normal((150, 8)) / 1e4])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x[:40]]))], "vec_id long, embedding array<double>")
    names, write = [], nn_descent.written
    monkeypatch.setattr(nn_descent, "written", lambda df, name: names.append(name) or write(df, name))
    how = {"every": 40, "k": 6, "beam": 15, "starts": 4, "rounds": 2, "sample": 4}
    held = nn_descent.search(d, **how).toPandas()
    assert names.count("found") == 1 and "graph" not in names
    joined = nn_descent.search(d, held_bytes=0, **how).toPandas()
    assert names.count("found") > 3 and "graph" in names
    order = ["query_id", "rank"]
    assert len(held) == 11 * 10 and held.sort_values(order).values.tolist() == joined.sort_values(order).values.tolist()


def test_neighbours_few(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (100, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nn_descent.search(d).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 1.0)]
    assert nn_descent.search(d.limit(0)).count() == 0


# Main text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu one</a></li><li>menu two</li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Caf&eacute; &lt;now&gt;</h1><p><b>First  paragraph,
with&nbsp;space.<br><p>Second <i>one</i>.<div class="share-buttons">Share!</div><p>&#8220;Third&#8221;</p><aside>See also</aside>
<section id="comments"><p>A reader said something long, really long, with commas, and more.</p></section></article>
<form><label>Name</label><input></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert main_text.main_text(PAGE) == "Café <now>\nFirst paragraph, with space.\nSecond one.\n“Third”"
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<p></p>") == ""
    assert main_text.main_text("just text") == "just text"
    deep = "<div>" * 3000 + "<p>in the middle of it all</p>" + "</div>" * 3000
    assert main_text.main_text(deep) == "in the middle of it all"
    plain = "<body><div><a href=x>one</a> <a href=y>two</a></div><div id='c'><p>Long text, with words. And more of them, here.</p><p>Short.</p></div></body>"
    assert "Long text, with words. And more of them, here.\nShort." in main_text.main_text(plain)


LOREM = "Some words of an article, in a sentence of their own; and then some more of them. It goes on for a while, as articles do. "


def test_main_text_without_article():
    """Pages whose tags and classes say nothing: the ratios of the paths find the text."""
    menu = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(9))
    soup = f"<body><div class=a1><ul>{menu}</ul></div><div class=b2><div class=c3><h2 id=share-price>Title</h2><p>{LOREM * 3}</p><p>Short.</p><p>{LOREM * 2}</p></div><div class=d4><a href=x>more</a> <a href=y>and more</a></div></div><div class=e5>© 2020</div></body>"
    assert main_text.main_text(soup) == "\n".join(x.strip() for x in ["Title", LOREM * 3, "Short.", LOREM * 2])
    thread = "".join(f"<div class=u{i}><b>user {i}</b><p>yes indeed {i}</p></div>" for i in range(40))
    assert main_text.main_text(soup.replace("</body>", f"<div class=f6>{thread}</div></body>")) == main_text.main_text(soup)
    thread = "".join(f"<div class=u><p>{LOREM}</p></div>" for i in range(40))
    assert main_text.main_text(soup.replace("</body>", f"<div class=comment-list>{thread}</div></body>")) == main_text.main_text(soup)
    two = f"<body><div><section><h2>One</h2><p>{LOREM}</p></section><section><h2>Two</h2><p>{LOREM}</p></section></div></body>"
    assert main_text.main_text(two) == "\n".join(["One", LOREM.strip(), "Two", LOREM.strip()])


def test_main_text_scores_decide():
    """The same classes, the other way round: what is chosen follows the text, not the place."""
    a, b = f"<p>{LOREM * 4}</p><p>{LOREM}</p>", "<p>no</p><p>yes</p>"
    for x, y in ((a, b), (b, a)):
        assert main_text.main_text(f"<div><div class=q>{x}</div><div class=r>{y}</div></div>") == f"{LOREM * 4}".strip() + "\n" + LOREM.strip()


def test_main_text_keeps_the_article_whole():
    for tag in ("<svg/>", "<math/>", "<svg><text>no</text></svg>", "<select><option>no<option>no</select>", "<iframe src=x></iframe>", "<object data=x></object>"):
        assert main_text.main_text(f"<article><p>A</p>{tag}<p>B</p></article>") == "A\nB", tag
    assert main_text.main_text("<article><p>A</p><select><option>no<p>B</p></article>") == "A\nB"
    assert main_text.main_text("<article><p>A</p><object>shown instead</object></article>") == "A\nshown instead"
    inner = '<h2 id="legal-history">H</h2><section id="social-impact"><p>S</p></section><div class="related-work"><p>R</p></div><p id="share-price">P</p>'
    assert main_text.main_text(f'<article class="legal">{inner}</article>') == "H\nS\nR\nP"
    assert main_text.main_text(f'<article><header><h1>T</h1><span>by line</span></header><div class="ad-slot">buy</div><p>{LOREM}</p><ul><li><a href=x>a source</a></li></ul><section class="comments"><p>{LOREM}</p></section></article>') == f"T\n{LOREM.strip()}\na source"


def test_main_text_rows(spark):
    """Nulls in any column, no rows, repeated rows and columns with clashing names."""
    rows = [(1, None, None, "x"), (None, "u", "<p>a</p>", None), (2, "u", "", "y"), (2, "u", "", "y")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in main_text.extract(d).collect())
    assert got == [(0, "u", "a", 1), (1, "", "", 0), (2, "u", "", 0), (2, "u", "", 0)]
    assert main_text.extract(d.limit(0)).count() == 0


def test_main_text_whole_table(spark):
    """The generated pages hold one article each: its blocks, cut out with a pattern."""
    import html

    for r in main_text.extract(table(spark, SF, "pages")).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        x = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.sub(r"<[^>]*>", " ", re.sub(r"<(?:/?p|/?h1)>", "\0", x)).split("\0")
        want = "\n".join(b for b in (re.sub(r"\s+", " ", html.unescape(z)).strip() for z in blocks) if b)
        assert r.text == want and r.n_chars == len(want)


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe(docs, tokenizer):
    got = by_id(bpe.encode_decode(docs, queries.vocabulary()), "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    assert bpe.encode_decode(docs.limit(0), queries.vocabulary()).count() == 0


ODD = ["it's I'LL they're", "<|startoftext|>x <|endoftext|><|ENDOFTEXT|>", "İstanbul ΑΣ ΣΑΣ ǅ", "é \x1c\x1d ​ x\x85y　z", "abcdefgh" * 400, "的" * 500 + "\U0001f389" * 300, "".join(random.Random(1).choices("abcdef", k=3000))]


def test_bpe_streaming(tokenizer):
    b = bpe.WordBpe(json.load(open(queries.vocabulary())))
    for t in [*ODD, *(x for x in TEXTS if x and len(x) < 6000), "ab" * 20_000]:
        assert b.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_words_come_in_runs(tokenizer, monkeypatch):
    """Known words are looked up many at a time, also where long ones, marks, odd spaces and unknown symbols lie between."""
    b, asked = bpe.WordBpe(json.load(open(queries.vocabulary()))), []
    stream = bpe.WordBpe.stream
    monkeypatch.setattr(bpe.WordBpe, "stream", lambda self, t: (asked.append(1) or x for x in stream(self, t)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    plain = "the quick brown fox " * 2000
    for t in (plain, " \t".join(ODD) * 30, "\u2003\x85 ".join(["a\u3000b", "x" * 65, "é" * 40, "<|endoftext|>", "word"] * 900), plain * 20):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert b.digest(t) == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    asked.clear()
    b.digest(plain)
    assert len(asked) <= 8000 // 1024 + 1


def test_transducer_keeps_little():
    b = bpe.WordBpe(json.load(open(queries.vocabulary())))
    s, most, out = bpe.WordStream(b.m), 0, []
    for c in "theinternationalisationof" * 400:
        out += s.feed([c])
        most = max(most, len(s.held))
    assert "".join([*out, *s.close()]) == "theinternationalisationof" * 400
    assert most <= b.m.lookahead + 256 < 2000


@pytest.mark.parametrize("seed", range(60))
def test_lookahead_is_sufficient(seed):
    """Over random merge lists, what leaves early is what merging the whole word gives."""
    r, tokens, merges = random.Random(seed), list("ab"), []
    for _ in range(r.randint(1, 14)):
        x, y = r.choice(tokens), r.choice(tokens)
        if x + y not in tokens:
            merges.append((x, y))
            tokens.append(x + y)
    m = bpe.Merges({t: i for i, t in enumerate(tokens)}, merges)
    for _ in range(50):
        word, out, s = [r.choice("ab") for _ in range(r.randint(1, 60))], [], bpe.WordStream(m, chunk=1)
        for c in word:
            out += s.feed([c])
        assert [*out, *s.close()] == m._short(word) == m._long(word)


def test_lookahead_of_an_unordered_list():
    assert bpe.Merges({}, [("ab", "c"), ("a", "b")]).lookahead is None


def test_bpe_goes_through_the_transducer(tokenizer, monkeypatch):
    """Every word is fed to it, and the decoded text comes from ids, a bounded run at a time."""
    b, most, decoded = bpe.WordBpe(json.load(open(queries.vocabulary()))), [], []
    fed = bpe.Decoder.feed_all

    def feed_all(self, ids):
        most.append(len(ids))
        decoded.extend(ids)
        return fed(self, ids)

    streamed = []
    feed = bpe.WordStream.feed
    monkeypatch.setattr(bpe.WordStream, "feed", lambda self, x: streamed.extend(x) or feed(self, x))
    monkeypatch.setattr(bpe.Decoder, "feed_all", feed_all)
    text = "short words here " + "the quick brown fox jumps " * 3000 + "abcdefgh" * 3000
    want = tokenizer.encode(text, add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert b.digest(text) == (len(want), sha(" ".join(map(str, want))), sha(tokenizer.decode(want, skip_special_tokens=False)))
    assert "".join(streamed).startswith("short</w>words</w>here</w>the</w>quick</w>")
    assert decoded == want and max(most) < 5000


def test_decoder_emits_whole_characters():
    b = bpe.WordBpe(json.load(open(queries.vocabulary())))
    d = bpe.Decoder(b, as_text=True)
    text = "日本語 \U0001f389 café"
    pieces = [d.feed(i) for i in b.encode(text)]
    assert "".join([*pieces, d.close()]).strip() == text
    assert all("�" not in p for p in pieces)


def test_regex_is_the_vocabularys():
    b = bpe.WordBpe(json.load(open(queries.vocabulary())))
    assert isinstance(b.split, regex.Pattern)
