"""The pipeline against plain versions of its stages, each on its own input."""

import zlib

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from driftglass.llm import langid
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import plain_similar


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def stages(spark, docs):
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], "unused").cache())
    return tables


def plain_choice(table):
    """Of all rows with an id in a component, the one that comes first by id, hash of the text and columns; rows without an id all stay."""
    named = [r for r in table if r[0] is not None]
    parts = {}
    for low, r in zip(plain_similar([r[1] for r in named]), named, strict=True):
        parts.setdefault(low, []).append(r)
    order = lambda r: (r[0], xxhash64(r[1]), *((x is not None, x) for x in r))
    return sorted([min(own, key=order) for own in parts.values()] + [r for r in table if r[0] is None], key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def xxhash64(text):
    """What Spark's xxhash64 gives for a string: the signed hash, the seed for null."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def check(spark, docs):
    first, told, lined, kept, packed = stages(spark, docs)
    model = langid.Classifier(langid.fit(first))
    expected = [r for r in rows(first) if not (p := model.predict(r[1]))[2] and p[1] > 0]
    assert rows(told) == expected
    texts = {}
    for i, text, _, _ in plain_lines([(r[0], r[1]) for r in expected]):
        texts.setdefault(i, []).append(text)
    assert sorted((r[0] or -1, r[1], r[4]) for r in rows(lined)) == sorted((i or -1, t, len(t)) for i, own in texts.items() for t in own)
    assert rows(kept) == plain_choice(rows(lined))
    assert {r["doc_id"] for r in packed.collect()} == {r[0] for r in rows(kept)}
    for t in (told, lined, kept):
        assert t.columns == docs.columns
    return kept


def test_table(spark, small):
    kept = check(spark, small)
    assert 0 < kept.count() < small.count()


def test_odd_rows(spark, odd):
    check(spark, odd)


def test_near_duplicates_go_row_by_row(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    table = [(1, a), (1, a), (2, a), (2, b), (3, b), (3, b), (3, a), (4, "one"), (4, "two"), (4, "two"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in table], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "unused")
    assert [r[:2] for r in rows(kept)] == sorted([(1, a), (2, b), (4, "one"), (4, "two"), (None, a)], key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    assert kept.columns == docs.columns


def test_clashing_columns_stay_as_they_are(spark, odd):
    names = ("score", "rejected", "lang_pred", "n_lines", "n_dropped", "text_hash", "row", "first")
    more = odd.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    for got, want in zip(stages(spark, more)[1:4], stages(spark, odd)[1:4], strict=True):
        assert got.columns == more.columns and got.count() == want.count()
        assert all(r[c] == f"own {c}" for r in got.collect() for c in names)


def test_empty(spark, none):
    assert [t.count() for t in stages(spark, none)] == [0] * 5


def test_run_equals_stages(spark, small):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    want = stages(spark, small)[-1]
    digest = lambda df: sorted((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert digest(got) == digest(want)
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) >= 0 for r in got.collect())
