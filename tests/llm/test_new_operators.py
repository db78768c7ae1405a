"""Fingerprints, phrases and clusters against brute force, over awkward tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from leadforge.llm import clusters, fingerprints, phrases

SCHEMA = "doc_id bigint, text string, lang string, hash int, block int, id int"


# fingerprints


def terms(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    a, b = terms(a), terms(b)
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def rows_for_fingerprints():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    long = [" ".join(word() for _ in range(rng.randint(80, 300))) for _ in range(40)]
    texts = [*long, long[0], long[1] + " and a little more", " ".join(["so it goes on and"] * 200), None, "", " \n\t", "x", "one two", "one two three four five", "abc" * 20_000]
    ids = [*range(0, 2 * len(texts), 2)]
    rows = [(i, t, "en", 1, 2, 3) for i, t in zip(ids, texts)]
    rows += [(7, long[3], None, None, None, None), (7, long[4], None, 1, 1, 1), (7, long[4], None, 1, 1, 1), (None, long[5], None, 1, 1, 1), (None, None, None, 1, 1, 1), (2**40, "end", None, 1, 1, 1)]
    rng.shuffle(rows)
    return rows


def test_fingerprints_pair_each_document_with_the_next(spark):
    rows = rows_for_fingerprints()
    got = fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    # rows with one id have an order of their own (by hash): any order of them is tried, and one must fit
    groups: dict = {}
    for i, t, *_ in rows:
        groups.setdefault(i, []).append(t or "")
    keys = sorted(groups, key=lambda k: (k is not None, k or 0))

    def expected(order):
        out = []
        for (i, t), (_, following) in zip(order, [*order[1:], order[0]]):
            half = len(t) // 2
            out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
        return Counter(out)

    found = Counter((r["id"], r["n_chars"], r["edited_digest"]) for r in got)
    orders = itertools.product(*(itertools.permutations(groups[k]) for k in keys))
    assert any(expected([(k, t) for k, ts in zip(keys, order) for t in ts]) == found for order in orders)


def test_fingerprints_estimate_weighted_similarity(spark):
    rows = [r for r in rows_for_fingerprints() if r[0] is not None and r[0] != 7]
    got = {r["id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = dict(sorted((r[0], r[1] or "") for r in rows))
    ids = list(texts)
    errors = []
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        t, half = texts[i], len(texts[i]) // 2
        errors.append(got[i]["near_edited"] - similarity(t, t[: len(t) - half] + texts[j][:half]))
        errors.append(got[i]["near_next"] - similarity(t, texts[j]))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.35
    share = lambda a, b: np.mean([a[4 * k : 4 * k + 4] == b[4 * k : 4 * k + 4] for k in range(48)])
    prints = {i: got[i]["fingerprint"] for i in ids}
    equal = [(i, j) for i, j in itertools.combinations(ids, 2) if texts[i] == texts[j]]
    assert equal and all(prints[i] == prints[j] for i, j in equal)
    assert share(prints[2], prints[82]) > 0.9  # a copy with a few words more
    wordless = [i for i in ids if not terms(texts[i])]
    assert len({prints[i] for i in wordless}) == 1 and len(wordless) == 3


def test_weights_count_in_fingerprints(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(5)) for _ in range(30)]
    rows, wanted = [], []
    for k in range(60):  # texts of the same lines, some of them several times
        picked = [rng.randint(1, 4) for _ in base]
        rows.append((k, " ".join(" ".join([line] * n) for line, n in zip(base, picked)), "en", 1, 1, 1))
    got = {r["id"]: r["near_next"] for r in fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k in range(60):
        wanted.append(similarity(rows[k][1], rows[(k + 1) % 60][1]))
    assert abs(np.mean([got[k] for k in range(60)]) - np.mean(wanted)) < 0.02


def test_fingerprints_of_one_row_and_none(spark):
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "a b c", "en", 1, 1, 1)], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_digest"] == hashlib.sha256(b"a b" + b"a ").hexdigest()
    assert fingerprints.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


# phrases


def brute_phrases(rows, least, longest=5, first=2000):
    out = []
    counts: dict = {}
    for _, text, lang, *_ in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(w)):
                for m in range(1, longest + 1):
                    if i + m <= len(w):
                        counts.setdefault(lang or "und", Counter())[tuple(w[i : i + m])] += 1
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p for p, c in f.items() if len(p) > 1 and c >= least}
        covered = {p for p in frequent for q in frequent if len(q) > len(p) and f[q] >= f[p] and any(q[i : i + len(p)] == p for i in range(len(q)))}
        scored = []
        for p in frequent - covered:
            score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -f[p], " ".join(p).encode(), f[p], f[p[:k]], f[p[k:]], n, score))
        for rank, row in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, row[2].decode(), *row[3:]))
    return sorted(out)


def rows_for_phrases():
    rng = random.Random(4)
    vocabulary = ["The", "the", "of", "große", "É", "é", "x y", "#", "a\x0b", "co", "pi", "lo", "t", "Aus", "\x1c"]
    texts = [" ".join(rng.choices(vocabulary, [9, 9, 7, 3, 2, 2, 1, 1, 1, 2, 2, 2, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(150)]
    texts = [t.replace(" co ", rng.choice([", ", ".\n", " co ", "\t"])) for t in texts] + ["in the long run of things. " * 90, None, "", " \t", "...", "word", "z" * 5_000]
    return [(i % 130, t, rng.choice(["en", "de", None, "und"]), 1, 1, 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("least", [5, 25])
def test_phrases_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(phrases, "CHUNK", 300)  # texts are cut between pieces
    rows = rows_for_phrases()
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", "h1"), least=least, first=40)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, first=40)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_full_maps_and_small_buffers_change_nothing(spark, monkeypatch):
    rows = rows_for_phrases()
    monkeypatch.setattr(phrases, "marked", lambda bits, at: np.ones(len(at), bool))
    held = phrases.Gatherer(["h1", "h2"])
    monkeypatch.setattr(phrases, "GATHERED", 50)
    held.at_most = 50
    rng = np.random.default_rng(0)
    pairs, out = [], []
    for _ in range(20):
        a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        pairs += list(zip(a.tolist(), b.tolist()))
        held.add("en", [a, b])
        out += list(held.full())
    out += list(held.out())
    total: Counter = Counter()
    for pdf in out:
        for r in pdf.itertuples():
            total[r.h1, r.h2] += r.f
    assert total == Counter(pairs) and len(out) > 1
    assert brute_phrases(rows, 10)  # the fixture has phrases


def test_quicksort_counts_equal_suffixes():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 3_000) for _ in range(5)]
    weights = rng.integers(1, 4, 3_000)
    found = {tuple(int(c[p]) for c in columns[:d]): w for p, d, w in phrases.multikey_quicksort(columns, weights, 40)}
    wanted: Counter = Counter()
    for i in range(3_000):
        for d in range(1, 6):
            prefix = tuple(int(c[i]) for c in columns[:d])
            if 0 in prefix:
                break
            wanted[prefix] += int(weights[i])
    assert found == {p: w for p, w in wanted.items() if w >= 40}


def test_scores_are_exact_beyond_64_bits(spark):
    big = [(10**12 + 7, 3 * 10**14 + 1, 10**12 + 9, 2 * 10**12 + 3), (10**15, 10**17 - 1, 10**15, 10**15 + 1), (100, 200, 100, 150)]
    df = spark.createDataFrame(big, "a bigint, n bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(phrases.cut_score(df["a"], df["n"], df["l"], df["r"])).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in big]


# clusters


def brute_clusters(rows, k=40, rounds=5, size=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members: dict = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centroids)]
    rows = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in rows:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), tuple(centroids[c])) for i, c, d in rows), key=str)


VECTORS = "vec_id bigint, embedding array<float>, cluster int, distance string, id int"


def clustered(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    return sorted(((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in clusters.clustered(df, **options).collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(6)
    grid = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, grid()) for i in range(250)] + [(3, grid()), (None, grid()), (None, grid())]
    rows += [(500, [0.1] * 3), (501, [0.1] * 5), (502, [0.1, None, 0.2, 0.3]), (503, [0.1, float("nan"), 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0, 0.0]), (505, None), (506, []), (507, [-0.001, 0.999, 3000.7, -1e-9])]
    for k, rounds in ((7, 5), (40, 2), (1, 3), (300, 1)):
        assert clustered(spark, rows, size=4, k=k, rounds=rounds) == brute_clusters(rows, k, rounds, 4)


def test_clusters_of_few_or_no_vectors(spark):
    assert clustered(spark, []) == [] and clustered(spark, [(1, [1.0])]) == []
    same = [(i, [0.5] * 64) for i in range(6)]
    assert clustered(spark, same) == brute_clusters(same)
    with pytest.raises(Exception, match="too large"):
        clustered(spark, [(1, [1e9] * 64)])


def test_orchard_search_finds_the_nearest_and_skips_most():
    rng = np.random.default_rng(7)
    centroids = rng.integers(-2_000, 2_000, (40, 8))
    vectors = centroids[rng.integers(0, 40, 4_000)] + rng.integers(-200, 200, (4_000, 8))
    lists, gaps = clusters.neighbours(centroids)
    best, distance = clusters.orchard(vectors, centroids, lists, gaps)
    every = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
