"""Encoders against the tokenizers library; the automaton, packing and the length histogram."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftglass.llm import bpe_automaton, packing, queries, token_counts, tokens

ALPHABET = list("abcdefghe  \n\t'sS tthe123.,!?éüß漢字😀  \x1c\x85İ") + ["<|endoftext|>", "  ", "\r\n", " the", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(tokens.load_json())


@pytest.fixture(scope="module")
def automaton():
    return bpe_automaton.Automaton(bpe_automaton.compile_automaton(tokens.load_json()))


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def random_texts(n):
    rng = random.Random(9)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoders_agree_with_the_library(library, automaton):
    encode = tokens.Encoder(tokens.load_json())
    for text in [*random_texts(4000), "", "x" * 20000, " " * 3000, "\n" * 500 + "a"]:
        want = ids_of(library, text).tobytes()
        assert automaton.encode(text) == want, text
        assert encode(text).astype("<u4").tobytes() == want, text
        assert automaton.decode(want) == library.decode(list(np.frombuffer(want, "<u4")), skip_special_tokens=False)


def test_small_tables_still_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "KEEP", 3)
    own = bpe_automaton.Automaton(bpe_automaton.compile_automaton(tokens.load_json()))
    for text in random_texts(200):
        assert own.encode(text) == ids_of(library, text).tobytes()


def test_very_long_words_take_linear_time(library, automaton):
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.process_time()
    ids = automaton.encode(word)
    assert time.process_time() - began < 30  # the library takes about one second, quadratic work minutes
    assert ids == ids_of(library, word).tobytes()
    assert all(len(x) <= bpe_automaton.LONG for x in automaton.kept)


def test_automaton_accepts_just_the_correct_tokenizations(automaton):
    """Every split of short words into tokens is a path exactly if it is the encoding."""
    labels = {v: k for k, v in automaton.ids.items()}

    def splits(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            if (i := automaton.ids.get(word[:n])) is not None:
                for rest in splits(word[n:]):
                    yield [i, *rest]

    for word in (b" hello", b"aaaa", b"the cat"[:6], b"banana", b"ioning"):
        paths = [s for s in splits(word) if all(automaton.has_arc(a, b) for a, b in zip(s[:-1], s[1:], strict=True))]
        assert paths == [automaton.word(word)], [[labels[i] for i in p] for p in paths]


def test_op3_digests(odd, library):
    got = {(r["doc_id"], r["n_tokens"]): (r["i"], r["d"]) for r in bpe_automaton.encode_decode(odd).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("i"), F.sha2(F.col("decoded").cast("binary"), 256).alias("d")).collect()}
    for r in odd.collect():
        ids = ids_of(library, r["text"])
        text = library.decode(ids.tolist(), skip_special_tokens=False)
        assert got[r["doc_id"], len(ids)] == (hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def check_packing(docs, library, window=1024, **how):
    rows = docs.select("doc_id", "text").collect()
    got = packing.pack(docs, window=window, **how).collect()
    by_sequence, pieces = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
    loss = 0
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= window
        loss += 0 if at & (at - 1) == 0 else window - at
    assert loss == 0
    whole = {}
    for r in rows:
        ids = np.append(ids_of(library, r["text"]), 0).astype("<u4")
        whole.setdefault((r["doc_id"], len(ids)), []).append(ids.tobytes())
    assert set(whole) == set(pieces)
    for key, texts in whole.items():
        size = key[1]
        assert sum(len(x) // 4 for _, x in pieces[key]) == size * len(texts)
        for start, ids in pieces[key]:
            assert any(t[4 * start : 4 * start + len(ids)] == ids for t in texts)
        if len(texts) == 1:
            assert b"".join(x for _, x in sorted(pieces[key])) == texts[0]


def test_packing_odd_rows(odd, library):
    check_packing(odd.coalesce(1), library)
    check_packing(odd, library, run_tokens=500)


def test_packing_table(small, library):
    check_packing(small, library)
    check_packing(small, library, window=128, run_tokens=5000)


def test_packing_digest(small):
    row = packing.pack(small).select("ids", F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(row["ids"])


def test_nnls_against_projected_descent():
    rng = np.random.default_rng(1)
    for _ in range(10):
        a, b = rng.random((12, 20)), rng.random(12) * 5
        x = packing.nnls(a, b)
        y = np.zeros(20)
        for _ in range(20000):
            y = np.maximum(y - a.T @ (a @ y - b) / np.linalg.norm(a, 2) ** 2, 0)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_packing_uses_combinations():
    """Lengths that pair up exactly leave nothing to the greedy step."""
    pieces = [(i, 0, n) for i, n in enumerate([256] * 40 + [768] * 40)]
    windows, rest = packing.pack_run(pieces, 1024)
    assert not rest and all(sorted(p[2] for p in w) in ([256, 768], [256] * 4) for w in windows)


def test_histogram_suffix_sums(small, odd, library):
    for docs in (small, odd):
        lengths = [len(ids_of(library, r["text"])) for r in docs.collect()]
        sums = token_counts.suffix_sums(token_counts.length_histogram(docs)).cache()
        rows = sums.collect()
        assert {r["n_tokens"] for r in rows} == set(lengths)
        for r in rows:
            n = r["n_tokens"]
            assert r["n_docs"] == lengths.count(n) and r["tokens"] == n * r["n_docs"]
            assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
            assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        cut = {r["context_limit"]: r["total"] for r in token_counts.truncated_totals(sums, [1, 100, 512, 10**6]).collect()}
        assert cut == {k: sum(min(x, k) for x in lengths) for k in (1, 100, 512, 10**6)}
        assert sorted(r["context_limit"] for r in token_counts.truncated_totals(sums, [4, 4, 7]).collect()) == [4, 7]
        assert token_counts.truncated_totals(sums, []).count() == 0
        shares = {r["share"]: r["n_tokens"] for r in token_counts.length_quantiles(sums, [0.0, 0.5, 1.0]).collect()}
        ordered = sorted(lengths)
        assert shares == {0.0: ordered[0], 0.5: ordered[-(-len(ordered) // 2) - 1], 1.0: ordered[-1]}


def test_empty_tables(none):
    assert packing.pack(none).count() == 0
    assert bpe_automaton.encode_decode(none).count() == 0
    sums = token_counts.suffix_sums(token_counts.length_histogram(none))
    assert sums.count() == 0
    assert token_counts.truncated_totals(sums, [5]).first()["total"] == 0
    assert token_counts.length_quantiles(sums, [0.5]).first()["n_tokens"] is None


def test_very_long_texts(spark, library):
    long = "Some words and more, 123. " * 40_000
    docs = spark.createDataFrame([(1, long), (2, "a"), (3, long + "é"), (4, "x" * 3000)], "doc_id long, text string")
    check_packing(docs, library)
    got = {r["n_tokens"]: r["n_docs"] for r in token_counts.length_histogram(docs).collect()}
    want = [len(ids_of(library, t)) for t in (long, "a", long + "é", "x" * 3000)]
    assert got == {n: want.count(n) for n in want}


def test_large_vocabularies_are_refused(monkeypatch):
    monkeypatch.setattr(bpe_automaton, "MOST_IDS", 1000)
    with pytest.raises(ValueError, match="50257 ids"):
        bpe_automaton.compile_automaton(tokens.load_json())


def test_clashing_columns(odd, library):
    plain, more = (sorted(map(tuple, token_counts.length_histogram(d).collect())) for d in (odd, odd.withColumn("n_tokens", F.lit("x")).withColumn("n_docs", F.lit(1))))
    assert plain == more
    check_packing(odd.coalesce(1).withColumn("start", F.lit("x")).withColumn("ids", F.lit(1)), library)
    assert bpe_automaton.encode_decode(odd.withColumn("ids", F.lit(1))).columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
