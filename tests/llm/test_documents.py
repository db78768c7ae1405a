"""Document operators against brute force, on awkward rows and an empty table."""

import collections
import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leadforge.llm import exact, mixing, ngrams, pieces, quality, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def test_quality_counts(docs, rows, nothing):
    def brute(text):
        w = WORD.findall(text or "")
        grams = list(zip(w, w[1:], w[2:]))
        seen = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    got = quality.quality_verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [(i, *brute(t)) for i, t, *_ in rows]
    assert sorted((tuple(x[:6]) for x in got), key=key) == sorted(want, key=key)
    for x in got:
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
        assert not (x["base_failed"] and x["kept"])
    assert {x["doc_id"] for x in got if x["kept"]} >= {1, 2, 3, 4, 15, 100}
    assert quality.quality_verdicts(nothing).count() == 0


def test_quality_filter_agrees_in_any_order(docs):
    kept = {x[0] for x in quality.quality_verdicts(docs).where("kept").select("doc_id").collect()}
    out = quality.quality_filter(docs)
    assert out.columns == docs.columns
    assert {x[0] for x in out.select("doc_id").collect()} == kept
    for rules in (quality.RULES, quality.RULES[::-1]):
        judged = quality.first_rejection(docs, F.col("text"), list(rules))
        assert {x[0] for x in judged.where(F.col(quality.VERDICT).isNull()).select("doc_id").collect()} == kept


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(docs, rows, nothing):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    want = []
    for i, t, *_ in rows:
        g = groups[normal(t)]
        low = min((x for x in g if x is not None), default=None)
        want.append((i, low, len(g), i is not None and i == low, hashlib.sha256(normal(t).encode()).hexdigest()))
    got = exact.exact_groups(docs).select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    assert sorted(map(tuple, got), key=lambda x: repr(x)) == sorted(want, key=lambda x: repr(x))
    assert exact.exact_groups(nothing).count() == 0
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    ids = [x[0] for x in out.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and ids.count(13) == 1 and 6 not in ids and 5 in ids
    assert len(ids) == len(groups)


@pytest.mark.parametrize("n", [1, 2, 100, 5000])
def test_perfect_hash_is_minimal(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    sizes, bits, slots = exact.build_function(digests)
    assert sorted(slots.tolist()) == list(range(n))
    strange = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(200)), np.uint8).reshape(-1, 32)
    assert ((exact.slots_of(strange, sizes, bits) >= -1) & (exact.slots_of(strange, sizes, bits) < n)).all()


def water_levels(sizes, weights, share):
    total = share * sum(sizes) / 100
    target, capped = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(2 * sizes[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        for i in open_:
            target[i] = rest * weights[i] / sum(weights[j] for j in open_)
        over = {i for i in open_ if target[i] > 2 * sizes[i]}
        if not over:
            break
        capped |= over
    return [2 * sizes[i] if i in capped else target[i] for i in range(len(sizes))]


def test_mixing(docs, rows, nothing):
    out = mixing.assign(docs).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_taken").collect()
    assert len(out) == len(rows)
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    want = dict(zip(names, water_levels([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 150)))
    taken = collections.Counter()
    for x in out:
        assert x["mix_source_size"] == size[x["source"]] and x["mix_target"] == pytest.approx(want[x["source"]])
        assert 0 <= x["mix_taken"] <= 2 * x["mix_size"]
        taken[x["source"]] += x["mix_taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.assign(docs.repartition(2)).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_taken").collect()))
    assert mixing.assign(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    assert max(collections.Counter(x[0] for x in mix.select("doc_id").collect() if x[0] != 13).values()) <= 2


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_similar_groups(docs, rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if both and 100 * both >= percent * either:
            root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            low[find(i)] = min(low.get(find(i), row[0]), row[0])
    want = [(row[0], len(sets[i]), low.get(find(i)) if sets[i] else row[0]) for i, row in enumerate(rows)]
    got = ngrams.similar_groups(docs, n=n, percent=percent).select("id", "n", "component").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_drop_similar(docs, nothing):
    out = ngrams.drop_similar(docs)
    assert out.columns == docs.columns
    ids = {x[0] for x in out.select("doc_id").collect()}
    assert 1 in ids and not ids & {2, 3, 15} and {4, 5, 6, 7, None} <= ids
    assert ngrams.drop_similar(nothing).count() == 0


def test_large_family_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_SETS", 7)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join("z" + str(i) if k == i * 3 else w for k, w in enumerate(base))) for i in range(40)]
    got = ngrams.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x["component"] for x in got} == {0} and len(got) == 40


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_routing_and_trie_lose_no_link(percent):
    rng = np.random.default_rng(percent)
    for _ in range(25):
        sets = []
        for _ in range(rng.integers(1, 5)):
            base = rng.integers(0, 2**63, rng.integers(1, 150)).astype(np.uint64)
            for _ in range(rng.integers(1, 10)):
                kept = base[rng.random(len(base)) > rng.random() * 0.2]
                more = rng.integers(0, 2**63, rng.integers(0, max(2, len(base) // 8))).astype(np.uint64)
                if len(s := np.unique(np.concatenate([kept, more]))):
                    sets.append(s)
        sets = list({s.tobytes(): s for s in sets}.values())
        counts = np.bincount(ngrams.counter_of(np.concatenate(sets)), minlength=1 << ngrams.COUNTER_BITS)
        for levels in (ngrams.levels_of(counts), np.zeros_like(counts, dtype=np.uint16)):
            routes = [set(ngrams.prefix(s, percent, levels).tolist()) for s in sets]
            assert all(len(r) <= len(s) - -(-percent * len(s) // 100) + ngrams.shared_grams(len(s)) for r, s in zip(routes, sets))
            links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
            needs = [ngrams.least_shared(len(s), percent) for s in sets]
            assert all(len(routes[i] & routes[j]) >= max(needs[i], needs[j]) for i, j in links)

        def classes(pairs):
            root = list(range(len(sets)))
            for i, j in pairs:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            return root

        assert classes(links) == classes(ngrams.trie_join(sets, percent))
        side = rng.integers(0, 2, len(sets))
        across = [(i, j) for i, j in links if side[i] != side[j]]
        assert classes(across) == classes(ngrams.trie_join(sets, percent, side))
        label = np.array(classes(links[::2]))
        assert classes(links) == classes([*links[::2], *ngrams.trie_join(sets, percent, None, label)])


@pytest.mark.parametrize("n,percent,edits", [(5, 80, 9), (5, 80, 14), (4, 85, 9), (3, 50, 60)])
def test_families_near_the_threshold_in_many_chunks(spark, monkeypatch, n, percent, edits):
    """Families whose members partly link, a passage that all texts share, and several chunks of each block."""
    monkeypatch.setattr(ngrams, "CHUNK_SETS", 7)
    rng = np.random.default_rng(edits)
    quoted = [f"q{i}" for i in range(60)]
    rows = []
    for family in range(3):
        base = [f"f{family}x{i}" for i in range(300)]
        for k in range(40):
            words = list(base)
            for at in rng.choice(300, rng.integers(0, edits), replace=False):
                words[at] = f"e{family}y{rng.integers(0, 40)}"
            rows.append((len(rows), " ".join(words[: rng.integers(250, 301)] + quoted[: rng.integers(0, 60)])))
    sets = [{tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    used = []
    links = ngrams._links
    monkeypatch.setattr(ngrams, "_links", lambda source, dealt, *a: used.append(dealt.groupBy("block").agg(F.countDistinct("low", "high").alias("n")).agg(F.max("n")).first()[0]) or links(source, dealt, *a))
    got = ngrams.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), n=n, percent=percent).collect()
    assert {x["id"]: x["component"] for x in got} == dict(enumerate(root))
    assert len(used) == 2 and used[0] > 3


def test_pieces_match_the_library(docs, rows, nothing):
    model = pieces.load(public_tokenizers.path(pieces.MODEL))
    got = {x["doc_id"]: x for x in pieces.encoded(docs).collect()}
    for i, t, *_ in rows:
        ids = model.library.encode(t or "", add_bos=True, add_eos=True)
        x = got[i]
        assert x["ids"] == ids and x["n_tokens"] == len(ids) and x["decoded"] == model.library.decode(ids)
        assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x["covered_bytes"] == len((t or "").encode())
        if t:
            spans = [(t.encode()[a:b].decode("utf-8", "ignore"), model.library.id_to_piece(k)) for a, b, k in zip(x["starts"], x["ends"], ids)]
            # a literal U+2581 of the text is the same to the model as a space
            assert all(piece.replace("▁", " ").strip() == text.replace("▁", " ").strip() for text, piece in spans if not piece.startswith("<"))
    assert pieces.encoded(nothing).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "▁x ▁▁ y", "a\n\n b\t", "\x00z", "日本語 テスト", "   ", "end ", "😀 😀😀  x", "<s> </s> <unk>", "a" * 3000])
def test_piece_edges(text):
    model = pieces.load(public_tokenizers.path(pieces.MODEL))
    (ids,), (back,) = model.encode([text])
    want = model.library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want and back == model.library.decode(want)
    a, b = model.spans(text, ids)
    assert (b >= a).all() and (b - a).sum() == len(text.encode())


def charsmap(entries):
    """A compiled character map (double array in the public format) of a few short entries, built by hand."""
    texts, place = b"", {}
    for k, v in entries.items():
        place[k] = len(texts)
        texts += v + b"\0"
    units = [0] * 4096
    free = [256]

    def put(prefix, at):
        after = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        ends = prefix in entries
        base = free[0]
        free[0] += 256
        units[at] |= (at ^ base) << 10 | (0x100 if ends else 0)
        if ends:
            units[base] = 1 << 31 | place[prefix]
        for c in after:
            units[base ^ c] = c
            put(prefix + bytes([c]), base ^ c)

    put(b"", 0)
    blob = np.array(units, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + texts


def test_longest_prefix_normalisation_keeps_offsets():
    model = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    model.map = pieces.CharacterMap(charsmap({b"A": b"a", b"AB": b"<ab>", "é".encode(): b"e"}))
    out, align = model.normalise("ABAé x")
    assert out.decode() == "▁<ab>ae▁x"
    assert align.tolist() == [0, 0, 0, 0, 0, 0, 0, 2, 3, 5, 5, 5, 6, 7]


def test_token_counts(docs, rows, nothing):
    encode = tokens.tokenizer(public_tokenizers.path(tokens.RANKS)).encode_ordinary
    want = sorted(((i, len(encode(t or ""))) for i, t, *_ in rows), key=key)
    for block in (1, 7, 1000, tokens.BLOCK_TOKENS):
        if block < 100:  # short texts, whose separators fall on all places of a block
            few = docs.where("doc_id in (5, 6, 7, 8, 9, 16)")
            assert sorted(map(tuple, tokens.token_counts(few, block_tokens=block).collect())) == [x for x in want if x[0] in (5, 6, 7, 8, 9, 16)]
        else:
            assert sorted(map(tuple, tokens.token_counts(docs, block_tokens=block).collect()), key=key) == want
    assert tokens.token_counts(nothing).count() == 0


def test_tokens_after_the_last_separator(spark, tmp_path):
    ids = np.array([5, 6, tokens.SEPARATOR, tokens.SEPARATOR, 7, 8, 9], "<u2")
    (tmp_path / "f").write_bytes(ids.tobytes())
    files = spark.createDataFrame([(str(tmp_path / "f"), 2 * len(ids))], "path string, bytes bigint")
    for block in (1, 2, 3, 10):
        got = tokens.count_tokens(files, f"file://{tmp_path}", block_tokens=block).select("ordinal", "n_tokens").collect()
        assert sorted(map(tuple, got)) == [(0, 2), (1, 0), (2, 3)]


def test_toxicity_on_held_out_rows(spark, nothing):
    import random

    rng = random.Random(3)
    plain = ["w%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "vile nasty words"), (5002, "x " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("clash"))
    known = spark.createDataFrame([*labels, (None, 1), (5001, None)], "doc_id bigint, toxic int")
    out = {x["doc_id"]: x for x in toxicity.toxicity(docs, known).collect()}
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in out.values())
    held = [(x["predicted"], dict(labels)[i]) for i, x in out.items() if i is not None and i < 1200 and x["held_out"]]
    assert len(held) > 150 and sum(a == b for a, b in held) / len(held) > 0.97
    assert out[5000]["score"] == out[5001]["score"]
    assert [x["score"] for x in toxicity.toxicity(docs.limit(3), known.where("toxic = 7")).collect()] == [0.0] * 3
    assert toxicity.toxicity(nothing, known).count() == 0


def test_a_rejected_row_sees_no_later_rule(spark):
    short = quality.Rule("short", lambda f: f["n_words"] < 5)
    trap = quality.Rule("trap", lambda f: F.when(f["n_letter_words"] >= 0, F.raise_error(F.lit("evaluated"))).cast("boolean"))
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    judged = quality.first_rejection(df, F.col("text"), [short, trap])
    assert [x[quality.VERDICT] for x in judged.collect()] == ["short", "short"]
    with pytest.raises(Exception, match="evaluated"):
        quality.first_rejection(df, F.col("text"), [trap, short]).collect()


@pytest.mark.parametrize("text,rule", [
    ("12 34 56 ab " * 20 + "1 " * 60, "few_letters"), ("- a b\n" * 30, "bullet_lines"), ("so it goes...\n" * 3 + "and on … \nthen this\n", "ellipsis_lines"), ("plain words here\n" * 30, None),
])
def test_rules_with_features_of_their_own(spark, text, rule):
    rules = [r for r in quality.RULES if r.name in ("few_letters", "bullet_lines", "ellipsis_lines")]
    for ordered in (rules, rules[::-1]):
        assert quality.first_rejection(spark.createDataFrame([(text,)], "text string"), F.col("text"), ordered).first()[quality.VERDICT] == rule


def test_a_sample_takes_some_files(spark, tmp_path):
    spark.range(200).selectExpr("id doc_id", "concat('word ', id) text").repartition(20).write.parquet(str(tmp_path / "many"))
    sample = quality.sample_of(spark.read.parquet(str(tmp_path / "many")), "text", 10_000)
    assert 20 < sample.count() < 120
    assert quality.sample_of(spark.read.parquet(str(tmp_path / "many")).where("doc_id < 0"), "text", 10).count() == 0
