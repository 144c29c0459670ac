"""Alignment against spans, groups and overlaps worked out token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from driftglass.llm import alignment

SCHEMA = "doc_id long, text string"
WORDS = ["the", "of", "Anwend", "ungs", "é", "naïve", "1234", "日本", "🙂", "\n", "  ", "don't", "<|endoftext|>", "</s>", "<0x41>", "supercalifragilistic", "\x00", "ﬁ", "é", " ", "A" * 40]


def spans(ids, label):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(label(i))))
        at = out[-1][2]
    return out


def brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    label_a = lambda i: bytes(table[c] for c in a.id_to_token(i))
    label_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    held, linked = [], Counter()
    for doc_id, text in rows:
        found = None
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if all(b"".join(map(label, own)) == (" " + text).encode() for own, label in zip(ids, (label_a, label_b), strict=True)):
                sa, sb = spans(ids[0], label_a), spans(ids[1], label_b)
                links = [(x[0], y[0]) for x in sa for y in sb if x[1] < y[2] and y[1] < x[2]]
                cuts = sorted({x[2] for x in sa} & {y[2] for y in sb})
                parts = [(low, high) for low, high in zip([0, *cuts], cuts, strict=False)]
                text_of = lambda own, low, high: ",".join(str(i) for i, s, e in own if low <= s and e <= high)
                found = len(sa), len(sb), ";".join(f"{text_of(sa, *p)}|{text_of(sb, *p)}" for p in parts), len(parts), links
                linked.update(set(links))
        held.append((doc_id, found))
    best = defaultdict(int)
    for (x, _), n in linked.items():
        best[x] = max(best[x], n)
    return sorted(
        (
            (d, f[0], f[1], f[3], len(f[4]), sum(linked[x] == best[x[0]] for x in f[4]), sum(linked[x] for x in f[4]), hashlib.sha256(f[2].encode()).hexdigest(), f[2])
            if f else (d, 0, 0, 0, 0, 0, 0, "", "")
            for d, f in held
        ),
        key=repr,
    )


def result(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in rows), key=repr)


@pytest.mark.parametrize("block", [3, 8192])
def test_equals_spans_and_overlaps(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "a▁b"), (203, " "), (204, "▁"), (205, "�"), (205, "the the"), (205, "the the"), (None, "the of")]
    assert result(alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3), groups=True, block=block)) == brute(rows)


def test_very_long_texts_and_empty_table(spark):
    rng = random.Random(5)
    rows = [(1, " ".join(rng.choice(WORDS) for _ in range(3000))), (2, "x" * 3000), (3, "the")]
    assert result(alignment.align(spark.createDataFrame(rows, SCHEMA), groups=True, block=100)) == brute(rows)
    more = spark.createDataFrame([(1, "a b", 5, "x")], SCHEMA + ", row int, ids string")
    assert result(alignment.align(more, groups=True)) == brute([(1, "a b")])
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_of_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [r for r in rows if len(r[1] or "") < 1500]
    assert result(alignment.align(spark.createDataFrame(rows, SCHEMA), groups=True)) == brute(rows)
