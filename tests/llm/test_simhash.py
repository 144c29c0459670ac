"""SimHash: fingerprints against a plain computation, components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftglass.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similar(texts):
    """For each text, the number of the first one that links of a similarity of 0.8 and over lead to, by all pairs."""
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 10 * len(a & b) >= 8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def plain_components(rows, bits=3):
    fps = sorted({fp for _, fp in rows})
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    low = {}
    for i, fp in rows:
        if i is not None:
            low[find(fp)] = min(low.get(find(fp), i), i)
    return [(i, f"{fp:016x}", low.get(find(fp))) for i, fp in rows]


def check(docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=key) == sorted(plain_components(rows), key=key)


def test_odd_rows(odd):
    check(odd)


def test_table(small):
    check(small)


def test_words_is_a_parameter(spark):
    text = "one two three four five six seven"
    shingles = ["one two three four five", "two three four five six", "three four five six seven"]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    docs = spark.createDataFrame([(1, text), (2, "one")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs, words=5).collect()}
    assert got == {1: f"{want:016x}", 2: f"{xxhash.xxh64_intdigest(b'one', 42):016x}"}


def test_very_long_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 100)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(20_000))) for i in range(3)]
    rows.append((7, rows[0][1]))
    check(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1)).withColumn("text_hash", F.lit("y")))


def test_decisions_name_copies_and_repeated_rows(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(1, a), (1, a), (2, a), (2, a), (2, b), (3, b), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["first"]) for r in simhash.decisions(docs).collect())
    assert got == [(1, True), (2, False), (3, False)]


def altered(rng, words, share):
    """The words with runs replaced until the similarity is about ``share``."""
    out, want = list(words), plain_shingles(" ".join(words))
    while True:
        own = plain_shingles(" ".join(out))
        if len(own & want) <= share * len(own | want):
            return out
        out[rng.randrange(len(out))] = f"n{rng.random()}"


def planted(rng, n):
    """Pairs of texts of 12 to 400 words at about 0.6, 0.7, 0.8 and 0.9."""
    pairs = []
    for i in range(4 * n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 30, 100, 400]))]
        pairs.append((" ".join(words), " ".join(altered(rng, words, (0.62, 0.72, 0.83, 0.9)[i % 4]))))
    return pairs


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b)


def test_similar_pairs_are_found_and_no_others(spark):
    pairs = planted(random.Random(7), 60)
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string").repartition(6)
    gone = {r["doc_id"] // 2 for r in simhash.decisions(docs).collect() if not r["first"]}
    near = [i for i, p in enumerate(pairs) if jaccard(*p) >= 0.8]
    assert gone <= set(near)
    assert len(gone) >= 0.92 * len(near) and len(near) > 50


def test_components_of_texts(spark):
    """Chains, clusters larger than FEW and BLOCK, texts without words, short texts."""
    rng = random.Random(2)
    texts = ["", None, " ", "one", "One", "one two", *(f"a b c d e f {i}" for i in range(4))]
    words = [f"w{i}" for i in range(120)]
    for _ in range(120):  # near copies of one text
        own = list(words)
        own[rng.randrange(120)] = f"x{rng.random()}"
        texts.append(" ".join(own))
    star = [f"s{i}" for i in range(100)]
    texts.append(" ".join(star))
    for i in range(40):  # each like the one in the middle, hardly like each other
        texts.append(" ".join([*star[:i], f"y{i}", *star[i + 1 : 99 - i], f"z{i}", *star[100 - i :]]))
    chain = [f"c{i}" for i in range(200)]
    for i in range(10):  # each like the one before
        texts.append(" ".join(chain[5 * i : 5 * i + 150]))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    first = plain_similar(texts)
    got = {r["doc_id"] for r in simhash.decisions(docs).collect() if not r["first"]}
    want = {i for i, low in enumerate(first) if low != i}
    assert got <= want and len(got) >= 0.97 * len(want)


def gone_of(docs):
    return {r["doc_id"] for r in simhash.decisions(docs).collect() if not r["first"]}


@pytest.mark.parametrize("block, few", [(2048, 1 << 16), (4, 3)])
def test_no_link_is_lost_in_clusters(spark, monkeypatch, block, few):
    """Versions of one text that aren't 0.8 alike, but each has a copy that is: stars around one member don't show that."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "RUN", few)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        own = altered(rng, base, 0.78)
        texts += [" ".join(own), " ".join(altered(rng, own, 0.83))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {i for i, low in enumerate(plain_similar(texts)) if low != i}
    assert gone_of(docs) == want and len(want) >= 40


def test_no_link_is_lost_at_the_threshold(spark, monkeypatch):
    """Pairs just at 0.8, with passages that many texts have, frequent or not in the sample."""
    monkeypatch.setattr(simhash, "FREQUENT", (20, 100))
    rng = random.Random(12)
    passages = [[f"p{k}x{i}" for i in range(rng.choice([3, 30]))] for k in range(6)]
    texts = ["", "one", "one two three four five six", "One two three four five six"]
    for i in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([9, 25, 60, 200]))] + passages[i % 6]
        texts += [" ".join(words), " ".join(altered(rng, words, 0.83))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {i for i, low in enumerate(plain_similar(texts)) if low != i}
    assert gone_of(docs) == want and len(want) > 60


def test_similar_sets_share_a_shingle_of_their_heads():
    rng = np.random.default_rng(4)
    common = np.sort(rng.integers(0, 1 << 63, 30).astype(np.uint64))
    rank = rng.permutation(30)
    for n in [1, 2, 4, 5, 6, 9, 10, 31, 200] * 20:
        a = np.concatenate([rng.choice(common, min(n // 2, 30), replace=False), rng.integers(0, 1 << 63, n - min(n // 2, 30)).astype(np.uint64)])
        b = rng.permutation(np.concatenate([rng.permutation(a)[: n - int(rng.integers(0, n // 5 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
        alike = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        heads = [set(simhash.head_of(np.sort(x), common, rank).tolist()) for x in (a, b)]
        assert not alike or heads[0] & heads[1]
        assert len(heads[0]) == n - -(-4 * n // 5) + 1


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for n in [0, 1, 5, 40, 300] * 10:
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        b = np.unique(np.concatenate([a[: n * 4 // 5], b[: n // 5]]))
        differing = bin((simhash.parity_of(np.unique(a)) ^ simhash.parity_of(b)) & ((1 << 64) - 1)).count("1")
        assert differing <= len(np.setxor1d(a, b))
    assert simhash.parity_of(np.array([63, 127, 0], np.uint64)) == 1 and simhash.parity_of(np.array([63], np.uint64)) == -(1 << 63)


def test_pairs_are_ruled_out_without_texts_and_no_similar_one_is(spark):
    """Sketches leave every pair of 0.8 or more, at sizes around the threshold, and hardly any of those far below."""
    rng = np.random.default_rng(9)
    sets, pairs = [], []
    for n in [1, 2, 4, 5, 6, 9, 10, 50, 300, 3000] * 12:
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        cut = int(n * rng.choice([0, 0.08, 0.1, 0.11, 0.125, 0.2, 0.4]))
        pairs.append((len(sets) + 1, len(sets), int(rng.integers(0, 3))))
        sets += [np.unique(pool[:n]), np.unique(pool[cut : n + cut])]
    nodes = spark.createDataFrame([(i, bytearray(simhash.sketch_of(x))) for i, x in enumerate(sets)], "node long, sketch binary").repartition(3)
    got = {(r["u"], r["v"], r["salt"]) for r in simhash.possible(spark.createDataFrame(pairs, "u long, v long, salt long"), nodes).collect()}
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    near = {p for p in pairs if alike(sets[p[0]], sets[p[1]]) >= 0.8}
    assert near <= got <= set(pairs) and len(near) > 40
    assert not [p for p in got if len(sets[p[0]]) in (50, 300, 3000) and alike(sets[p[0]], sets[p[1]]) < 0.5]


def test_texts_are_asked_for_where_pairs_may_be_similar(spark, monkeypatch):
    """Texts that share a passage and meet in their keys or heads, but aren't alike: no shingles of theirs are shuffled."""
    rng = random.Random(13)
    fetched = []
    monkeypatch.setattr(simhash, "sets_of", lambda pairs, *more, own=simhash.sets_of: fetched.append(own(pairs, *more)) or fetched[-1])
    passages = [[f"p{k}x{i}" for i in range(100)] for k in range(10)]
    texts = [" ".join([*passages[i % 10], *(f"w{rng.random()}" for _ in range(60))]) for i in range(80)]
    texts += [" ".join(altered(rng, t.split(), 0.85)) for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert gone_of(docs) == {80, 81, 82, 83, 84}
    assert sum(x.count() for x in fetched) == 10


@pytest.mark.parametrize("most", [4096, 5])
def test_rows_of_shared_keys(spark, monkeypatch, most):
    rng = random.Random(14)
    rows = [(k, i) for i, k in enumerate([rng.randrange(10_000) for _ in range(3000)] + [-1] * 40)]
    want = [r for r in rows if sum(k == r[0] for k, _ in rows) > 1]
    for places in (1 << 24, 64):
        monkeypatch.setattr(simhash, "PLACES", places)
        got = simhash.shared_only(spark.createDataFrame(rows, "met long, node long").repartition(3), "met", most)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_shared_heads_are_those_of_several_nodes(spark):
    rng = random.Random(6)
    rows = [(n, [rng.randrange(300) for _ in range(rng.randrange(1, 9))]) for n in range(200) for _ in range(rng.choice([1, 1, 3]))]
    rows = [(n, sorted(set(h))) for n, h in rows] + [(0, None)]
    held = {}
    for n, h in rows:
        for k in h or []:
            held.setdefault(k, set()).add(n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [(r["key"], r["node"]) for r in simhash.shared_heads(spark.createDataFrame(rows, "node long, head array<long>").repartition(3)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted((k, n) for k, own in held.items() if len(own) > 1 for n in own)


def test_frequent_shingles_are_known_in_large_tables(spark):
    """Passages of 80 among 82,000 texts: were they not known, each would make thousands of pairs, and the more the larger the table."""
    n, each = 82_000, 80
    docs = spark.range(n).selectExpr("id doc_id", f"concat('a b c d p', id div {each}) text").repartition(8)
    found = simhash.frequent(docs)
    passages = {int(simhash.shingle_hashes(f"a b c d p{k}")[0]) for k in range(-(-n // each))}
    assert set(found.tolist()) <= passages and len(found) >= 0.9 * len(passages)


def test_frequent_shingles_come_by_number_and_whole_counts_are_left_out(spark, monkeypatch):
    texts = [w for w, n in (("a", 1), ("b", 2), ("c", 3), ("d", 3), ("e", 5)) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name = {int(simhash.shingle_hashes(w)[0]): w for w in "abcde"}
    for most, want in ((4, "bcde"), (3, "cde"), (2, "e"), (0, "")):
        monkeypatch.setattr(simhash, "FREQUENT", (2, most))
        got = [name[x] for x in simhash.frequent(docs).tolist()]
        assert sorted(got) == list(want) and sorted(map(texts.count, got)) == list(map(texts.count, got))


@pytest.mark.parametrize("places", [1 << 24, 1 << 15, 100])
def test_asked_rows_are_all_there(spark, monkeypatch, places):
    monkeypatch.setattr(simhash, "PLACES", places)
    docs = spark.range(5000).selectExpr("id doc_id", "-7919 * id text_hash", "cast(id AS string) text")
    reps = docs.where("doc_id % 37 = 0").select("doc_id", "text_hash", F.lit(1).alias("node"))
    got = [r["doc_id"] for r in simhash.asked(docs, reps, ["doc_id", "text_hash"]).collect()]
    assert len(got) == len(set(got)) and set(range(0, 5000, 37)) <= set(got)
    assert places == 100 or len(got) < 200
    assert simhash.asked(docs, reps.limit(0), ["doc_id", "text_hash"]).isEmpty()


def test_meetings_are_whole_or_stars(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 3)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    keyed = spark.createDataFrame([(1, n, n) for n in range(17)] + [(2, 5, 0), (2, 6, 0), (2, 7, 0), (3, 9, 0), (1, 3, 3)], "key long, node long, fp long")
    got = {(r["u"], r["v"]) for r in simhash.meetings(keyed).collect()}
    assert {(6, 5), (7, 5), (7, 6)} <= got and all(u > v for u, v in got)
    root = {n: n for n in range(17)}
    find = lambda x: x if root[x] == x else find(root[x])
    for u, v in got:
        root[find(u)] = find(v)
    assert len({find(n) for n in range(17)}) == 1 and len(got) <= 17 + 4 + 3


def test_the_pivot_is_the_usual_one():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = [base] + [base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << 5) * (i % 3 == 0) for i in range(50)]
    rng.shuffle(fps)
    assert fps[simhash.pivot_of(np.arange(51), np.array(fps, np.uint64))] == base


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0


def flipped(base, bits):
    for b in bits:
        base ^= 1 << b
    return base - (1 << 64) if base >> 63 else base


@pytest.mark.parametrize("limit", [4096, 6])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, limit):
    """Chains and hot groups, with and without block splitting."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            fps.add(flipped(base, rng.sample(range(64), rng.randint(0, 4))))
            if rng.random() < 0.2:
                base ^= 1 << rng.randrange(64)
    monkeypatch.setattr(simhash, "LIMIT", limit)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    df = spark.createDataFrame([(x,) for x in fps], "fp long").withColumn("doc_id", F.monotonically_increasing_id())
    edges = [(r["u"], r["v"]) for r in simhash.links(df.select("fp")).collect() if r["v"] is not None]
    mask = (1 << 64) - 1
    order = sorted(fps)

    def classes(pairs):
        root = {x: x for x in order}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for x in order:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    pairs = [(a, b) for i, a in enumerate(order) for b in order[:i] if bin((a ^ b) & mask).count("1") <= 3]
    assert classes(edges) == classes(pairs)


def test_variants_meet_for_up_to_three_bits(spark):
    rng = np.random.default_rng(1)
    a = int(rng.integers(0, 1 << 62))
    pairs = [(a, flipped(a, rng.choice(64, 3, replace=False).tolist())) for _ in range(50)]
    df = spark.createDataFrame([(x,) for p in pairs for x in p], "fp long").distinct()
    keys = {}
    for r in simhash.variants(df).collect():
        keys.setdefault(r["fp"], set()).add(r["key"])
    assert all(keys[x] & keys[y] for x, y in pairs)
    assert all(len(v) == 64 for v in keys.values())
