"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted hash arrays, memory-mapped for scoring.

Tokens are 64-bit hashes of lower-cased words, plus one end per text; a text's first tokens have begin marks as history.

1. Each task reduces its training texts, ``RUN`` tokens at a time, to distinct n-grams of the highest order and deals
   them by the hash of their history: one compressed blob per run and shard, words as numbers into the blob's own table.
2. A shard of the highest order adds its blobs up and writes one file: sorted hashes of n-grams with their counts, and
   sorted hashes of histories with their total and how many n-grams were seen once, twice, and three times or more.
   It passes on each n-gram without its first word, with the number of distinct first words, to the next lower order.
3. So on down to single words, whose files hold the exact count and the number of distinct words before them.
4. Scoring maps one shard at a time. Discounts and interpolation weights follow from counts of counts, a handful of numbers.

Shards grow in number with the input, so a shard's size is bounded. A history that makes up over one shard's share of
a sample of the corpus is dealt over several shards by its next token, as many as its share asks for; there are at most
as many such histories as shards (the sample decides only where rows go, never a count), and their totals travel with
the model's few numbers. With more than ``FAN`` shards, blobs go to groups of shards first, so a run never makes more than ``FAN``.

Keys of n-grams keep 32 bits below those that name the entry's bucket, so an unseen n-gram passes for a seen one about
4 times in 10^9 lookups; words keep all 64 bits. Every shard writes its file, an empty one as well: a missing file is an error.

Defined cases: null and empty texts are one end token; very long texts are hashed, counted and scored a stretch at a
time; a null doc_id is trained on and not held out; repeated rows count each time; with nothing to train on every
token has probability 1 and all counts are 0. Ties don't arise. Other columns are not read.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.common import map_file, mix64, put_file, shared_path

ORDER = 2
BEGIN = np.uint64(0x243F6A8885A308D3)
END = np.uint64(0x13198A2E03707344)
RUN = 2_000_000  # tokens reduced at a time
SHARD = 2_000_000  # tokens, before reduction, for each shard
FAN = 1024  # shards, or groups of shards, that a run is dealt to
SAMPLED = 2_000_000  # tokens of the sample, within the shares below
LEAST_SHARE, MOST_SHARE = 1 / 1024, 1 / 16
SCORE_RUN, PER_SHARD, MOST_RUN = 200_000, 2000, 3_000_000  # tokens scored at a time: so many for each shard, within bounds
STRETCH = 1 << 20  # bytes of a text hashed at a time
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def held_out(doc_id: str = "doc_id", folds: int = 10, fold: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def hashes(data: bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in data.split()]), "<u8")


def stretches(text: str | None, order: int):
    """The tokens of a text in stretches, each behind the ``order`` - 1 tokens before it; the last one ends with END."""
    data = text.encode().lower() if text else b""
    before = np.full(order - 1, BEGIN)
    at = 0
    while len(data) - at > STRETCH and (cut := BLANK.search(data, at + STRETCH)):
        own = np.concatenate([before, hashes(data[at : cut.start()])])
        yield own
        before, at = own[len(own) - order + 1 :], cut.start()
    yield np.concatenate([before, hashes(data[at:] if at else data), np.array([END])])


def grams_of(parts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All stretches end to end, the places of their own tokens, and how many each has."""
    size = np.array([len(x) - order + 1 for x in parts], np.int64)
    flat = np.concatenate(parts)
    first = np.cumsum(size) - size + (order - 1) * np.arange(1, len(parts) + 1)
    return flat, np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size), size


def extend(key: np.ndarray | None, word: np.ndarray) -> np.ndarray:
    """The key of a sequence of words with one more word behind."""
    return mix64(word if key is None else key + word)


def sequence_key(columns: list[np.ndarray]) -> np.ndarray:
    key = None
    for c in columns:
        key = extend(key, c)
    return key


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.empty(0, np.int64)


def history_shard(history: np.ndarray, token: np.ndarray, hot: tuple[np.ndarray, np.ndarray], shards: int) -> np.ndarray:
    """Shards by history; those of ``hot`` (sorted keys, numbers of shards) by the next token as well."""
    h = mix64(history ^ np.uint64(0xA4093822299F31D0))
    keys, spread = hot
    if len(keys):
        at = np.minimum(np.searchsorted(keys, history), len(keys) - 1)
        h = h + np.where(keys[at] == history, mix64(token) % spread[at], np.uint64(0))
    return (h % np.uint64(shards)).astype(np.int64)


def word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(word ^ np.uint64(0x082EFA98EC4E6C89)) % np.uint64(shards)).astype(np.int64)


def place(words: list[np.ndarray], hot: dict, shards: int) -> np.ndarray:
    """The shard of each n-gram, given its words."""
    if len(words) == 1:
        return word_shard(words[0], shards)
    return history_shard(sequence_key(words[:-1]), words[-1], hot[len(words)], shards)


def _pack(*arrays: np.ndarray) -> bytes:
    head = json.dumps([[len(x), x.dtype.str] for x in arrays]).encode()
    out = [np.int64(len(head)).tobytes(), head, b" " * (-len(head) % 8)]
    for x in arrays:
        out += [x.tobytes(), b"\0" * (-x.nbytes % 8)]
    return b"".join(out)


def _unpack(data) -> list[np.ndarray]:
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    n = int(data[:8].view(np.int64)[0])
    out, at = [], 8 + n + -n % 8
    for size, kind in json.loads(bytes(data[8 : 8 + n])):
        kind = np.dtype(kind)
        out.append(data[at : at + size * kind.itemsize].view(kind))
        at += size * kind.itemsize + -(size * kind.itemsize) % 8
    return out


def _small(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def to_blob(columns: list[np.ndarray], vocabulary: np.ndarray, *values: np.ndarray) -> bytes:
    """N-grams (columns of numbers into ``vocabulary``) and their values with a table of just the words that occur."""
    flat = np.concatenate(columns)
    if 8 * len(flat) > len(vocabulary):
        number = np.zeros(len(vocabulary), np.int64)
        number[flat] = 1
        used = np.flatnonzero(number)
        number[used] = np.arange(len(used))
        flat = number[flat]
    else:
        used, flat = np.unique(flat, return_inverse=True)
    packed = _pack(vocabulary[used], *np.split(_small(flat), len(columns)), *map(_small, values))
    return zstandard.ZstdCompressor(level=1).compress(packed)


def from_blobs(blobs: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Vocabulary, columns, values and raw counts of all blobs together."""
    open_ = zstandard.ZstdDecompressor()
    held = [_unpack(open_.decompress(x)) for x in blobs]
    if not held:
        return np.empty(0, np.uint64), [np.empty(0, np.int64)] * order, np.empty(0, np.int64), np.empty(0, np.int64)
    vocabulary, number = np.unique(np.concatenate([b[0] for b in held]), return_inverse=True)
    start = np.cumsum([0, *(len(b[0]) for b in held)])
    columns = [np.concatenate([number[b[1 + c] + s] for b, s in zip(held, start, strict=False)]) for c in range(order)]
    values = np.concatenate([b[1 + order] for b in held]).astype(np.int64)
    raw = np.concatenate([b[-1] for b in held]).astype(np.int64)  # at the highest order the values are the raw counts
    return vocabulary, columns, values, raw


def distinct(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts n-grams by their columns, and where each distinct one begins in it."""
    code, span = columns[0].astype(np.int64), size
    for c in columns[1:]:
        if span * size >= 1 << 63:
            known, code = np.unique(code, return_inverse=True)
            span = len(known)
        code, span = code * size + c, span * size
    order = np.argsort(code)
    return order, _runs(code[order])


def deal(columns: list[np.ndarray], vocabulary: np.ndarray, values: list[np.ndarray], shard: np.ndarray):
    """Blobs by shard."""
    order = np.argsort(_small(shard), kind="stable")
    shard = shard[order]
    cuts = np.concatenate([_runs(shard), [len(shard)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[a:b]
        yield int(shard[a]), to_blob([c[own] for c in columns], vocabulary, *(v[own] for v in values))


def hot_histories(docs: DataFrame, order: int, tokens: float, shards: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order: histories over one shard's share of a sample of documents, and the number of shards for each. At most ``shards`` each."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                flat, at, _ = grams_of(list(stretches(text.as_py(), order)), order)
                levels, keys, counts = [np.zeros(1, np.int32)], [np.zeros(1, np.int64)], [np.array([len(at)])]
                for k in range(2, order + 1):
                    key, n = np.unique(sequence_key([flat[at - j] for j in range(k - 1, 0, -1)]), return_counts=True)
                    levels.append(np.full(len(key), k, np.int32))
                    keys.append(key.view(np.int64))
                    counts.append(n)
                yield pa.RecordBatch.from_pydict({"level": np.concatenate(levels), "key": np.concatenate(keys), "n": np.concatenate(counts)})

    share = min(MOST_SHARE, max(LEAST_SHARE, SAMPLED / max(tokens, 1)))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    counted = some.mapInArrow(run, "level int, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.expr("level > 0"), F.desc("n")).limit(1 + shards * (order - 1)).collect()
    total = next((r["n"] for r in rows if r["level"] == 0), 0)
    found = {}
    for k in range(2, order + 1):
        own = sorted((r["key"] % (1 << 64), -(-2 * r["n"] * shards // total)) for r in rows if r["level"] == k and r["n"] * shards > total)
        found[k] = (np.array([x[0] for x in own], np.uint64), np.array([x[1] for x in own], np.uint64))
    return found


SHIPPED = "bundle long, shard long, payload binary"


def _shipped(rows, bundle: int) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_pydict({"bundle": pa.array([bundle] * len(rows), pa.int64()), "shard": pa.array([r[0] for r in rows], pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _width(shards: int) -> int:
    """Shards in a group: 1, or so many that no more than FAN groups are dealt to."""
    return -(-shards // FAN)


def count_runs(train: DataFrame, order: int, hot: dict, shards: int) -> DataFrame:
    """Blobs of distinct n-grams of the highest order, by group of shards."""
    width = _width(shards)

    def reduce(parts):
        flat, at, _ = grams_of(parts, order)
        vocabulary, number = np.unique(flat, return_inverse=True)
        columns = [number[at - j] for j in range(order - 1, -1, -1)]
        by, new = distinct(columns, len(vocabulary))
        n = np.diff(np.concatenate([new, [len(by)]]))
        columns = [c[by[new]] for c in columns]
        return deal(columns, vocabulary, [n], place([vocabulary[c] for c in columns], hot, shards) // width)

    def run(batches):
        parts, held, bundle = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for text in batch.column(0):
                for part in stretches(text.as_py(), order):
                    parts.append(part)
                    held += len(part)
                    if held >= RUN:
                        yield _shipped(reduce(parts), bundle)
                        parts, held, bundle = [], 0, bundle + 1
        if parts:
            yield _shipped(reduce(parts), bundle)

    return train.select("text").mapInArrow(run, SHIPPED)


def by_shard(blobs: DataFrame, size: int, order: int, hot: dict, shards: int) -> DataFrame:
    """Blobs by shard, at least one row for each. Beyond FAN shards, bundles of runs are first added up by group of shards and dealt again."""
    width = _width(shards)
    if width > 1:

        def split(table: pa.Table) -> pa.Table:
            vocabulary, columns, values, raw = from_blobs(table.column("payload").to_pylist(), size)
            by, new = distinct(columns, len(vocabulary))
            columns = [c[by[new]] for c in columns]
            added = [np.add.reduceat(v[by], new) for v in ([values] if size == order else [values, raw])]
            rows = deal(columns, vocabulary, added, place([vocabulary[c] for c in columns], hot, shards))
            return pa.Table.from_batches([_shipped(rows, 0)])

        blobs = blobs.withColumn("bundle", F.pmod(F.xxhash64("bundle"), F.lit(width))).groupBy("bundle", "shard").applyInArrow(split, SHIPPED)
    every = blobs.sparkSession.range(shards).selectExpr("0L bundle", "id shard", "cast(null as binary) payload")
    return blobs.unionByName(every)


def key_file(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts 64-bit keys, where each bucket of leading bits begins, and the 32 bits that follow."""
    order = np.argsort(key)
    key = key[order]
    bits = max(0, min(16, len(key).bit_length() - 4))
    begins = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
    return order, np.concatenate([begins, [len(key)]]).astype(np.int64), (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)


def find(begins: np.ndarray, low: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each key stands, or -1: a binary search inside its bucket, for all keys at once."""
    bits = (len(begins) - 2).bit_length()
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    want = (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    a, end = begins[bucket], begins[bucket + 1]
    b = end.copy()
    if not len(low):
        return np.full(len(key), -1)
    while (a < b).any():
        middle = (a + b) >> 1
        less = (low[np.minimum(middle, len(low) - 1)] < want) & (a < b)
        b = np.where(less | (a == b), b, middle)
        a = np.where(less, middle + 1, a)
    there = (a < end) & (low[np.minimum(a, len(low) - 1)] == want)
    return np.where(there, a, -1)


def narrow(values: np.ndarray) -> list[np.ndarray]:
    """Numbers as bytes, with the places and values of those over 254."""
    large = np.flatnonzero(values > 254)
    return [np.minimum(values, 255).astype(np.uint8), large, values[large]]


def widen(held: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    found = held[0][at].astype(np.int64)
    large = np.flatnonzero(found == 255)
    if len(large):
        found[large] = held[2][np.searchsorted(held[1], at[large])]
    return found


def coded(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of numbers as bytes that number the 255 most frequent rows, with the places and values of all others."""
    code = rows[:, 0]
    for c in range(1, rows.shape[1]):
        code = code * 251 + np.minimum(rows[:, c], 250)
    code = np.where((rows[:, 0] < 1 << 30) & (rows[:, 1:] < 250).all(axis=1), code, -1)
    known, first, inverse, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    most = np.argsort(np.where(known < 0, 0, -n), kind="stable")[:255]
    most = most[known[most] >= 0]
    number = np.full(len(known), 255, np.uint8)
    number[most] = np.arange(len(most))
    own = number[inverse]
    other = np.flatnonzero(own == 255)
    return [own, rows[first[most]].ravel(), other, rows[other].ravel()]


def decoded(held: list[np.ndarray], at: np.ndarray, width: int) -> np.ndarray:
    own, table, other, rest = held
    number = own[at].astype(np.int64)
    large = np.flatnonzero(number == 255)
    number[large] = 0
    found = np.array(table.reshape(-1, width)[number]) if len(table) else np.zeros((len(at), width), np.int64)
    if len(large):
        found[large] = rest.reshape(-1, width)[np.searchsorted(other, at[large])]
    return found


STATS = 4  # of a history: total, and its n-grams seen once, twice, three times or more


def merge_grams(folder: str, size: int, order: int, hot: dict, shards: int):
    """Add up a shard of n-grams of ``size`` words, write its files, pass on what the next lower order counts."""
    width = _width(shards)

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        vocabulary, columns, values, raw = from_blobs([x for x in table.column("payload").to_pylist() if x is not None], size)
        by, new = distinct(columns, max(len(vocabulary), 1))
        columns = [c[by[new]] for c in columns]
        values, raw = (np.add.reduceat(v[by], new) if len(new) else v for v in (values, raw))
        words = [vocabulary[c] for c in columns]
        history = sequence_key(words[:-1])
        to, begins, low = key_file(extend(history, words[-1]))
        own = _runs(history)  # n-grams stand in the order of their columns, so equal histories are neighbours
        stats = np.stack([np.add.reduceat(x.astype(np.int64), own) if len(own) else np.empty(0, np.int64) for x in (values, values == 1, values == 2, values > 2)], axis=1)
        history = history[own]
        spread = np.isin(history, hot[size][0])
        h_to, h_begins, h_low = key_file(history[~spread])
        put_file(f"{folder}/grams-{size}-{shard}", _pack(begins, low, *narrow(values[to]), h_begins, h_low, *coded(stats[~spread][h_to])))
        seen = np.array([(values == k).sum() for k in (1, 2, 3, 4)], np.int64)
        put_file(f"{folder}/sums-{size}-{shard}", _pack(seen, history[spread], stats[spread].ravel()))
        columns = columns[1:]
        by, new = distinct(columns, max(len(vocabulary), 1))
        columns = [c[by[new]] for c in columns]
        before = np.diff(np.concatenate([new, [len(by)]]))
        raw = np.add.reduceat(raw[by], new) if len(new) else raw
        to = place([vocabulary[c] for c in columns], hot, shards) // width
        return pa.Table.from_batches([_shipped(deal(columns, vocabulary, [before, raw], to), shard)])

    return merge


def merge_words(folder: str):
    """Add up a shard of single words and write its file."""

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        vocabulary, (number,), values, raw = from_blobs([x for x in table.column("payload").to_pylist() if x is not None], 1)
        before, count = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        np.add.at(before, number, values)
        np.add.at(count, number, raw)
        put_file(f"{folder}/words-{shard}", _pack(vocabulary, count, before))
        spread = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 2).sum())]
        return pa.table({"tokens": [int(count.sum())], "known": [len(vocabulary)], "grams": [int(before.sum())], "spread": pa.array([spread], pa.list_(pa.int64()))})

    return merge


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The three modified Kneser-Ney discounts; where a count of counts is missing, the largest that keeps them in order."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    found = [i - (i + 1) * y * b / a if a else i * y for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(float(np.clip(d, 0.01, i - 0.01)) for i, d in enumerate(found, 1))])


def _sums(spark, folder: str, order: int, shards: int) -> tuple[dict, dict]:
    """By order: discounts, and the sorted keys and stats of histories that are dealt over several shards."""

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for k in range(2, order + 1):
                    seen, keys, stats = _unpack(map_file(f"{folder}/sums-{k}-{shard}"))
                    rows = np.concatenate([seen.reshape(1, STATS), stats.reshape(-1, STATS)])
                    yield pa.RecordBatch.from_pydict({
                        "level": np.full(len(rows), k, np.int32), "whole": np.arange(len(rows)) == 0, "key": np.concatenate([[0], keys.view(np.int64)]), **{f"s{i}": rows[:, i] for i in range(STATS)},
                    })

    names = [f"s{i}" for i in range(STATS)]
    found = spark.range(shards).mapInArrow(run, f"level int, whole boolean, key long, {', '.join(f'{n} long' for n in names)}")
    rows = found.groupBy("level", "whole", "key").agg(*[F.sum(n).alias(n) for n in names]).collect()
    discount, hot = {}, {}
    for k in range(2, order + 1):
        discount[k] = discounts(*next(([r[n] for n in names] for r in rows if r["level"] == k and r["whole"]), [0] * STATS))
        own = sorted((r["key"] % (1 << 64), *(r[n] for n in names)) for r in rows if r["level"] == k and not r["whole"])
        hot[k] = (np.array([x[0] for x in own], np.uint64), np.array([x[1:] for x in own], np.int64).reshape(-1, STATS))
    return discount, hot


def train(docs: DataFrame, order: int = ORDER) -> dict:
    """Count all rows of ``docs`` and write the arrays; returns where they are and the model's few numbers."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    tokens = (docs.agg(F.sum(F.length("text") + 6)).first()[0] or 0) / 6.0
    shards = int(tokens / SHARD) + 1
    hot = hot_histories(docs, order, tokens, shards)
    folder = shared_path(spark, "ngrams")
    blobs = count_runs(docs, order, hot, shards)
    for size in range(order, 1, -1):
        merged = by_shard(blobs, size, order, hot, shards).groupBy("shard")
        blobs = merged.applyInArrow(merge_grams(folder, size, order, hot, shards), SHIPPED)
    parts = by_shard(blobs, 1, order, hot, shards).groupBy("shard").applyInArrow(merge_words(folder), "tokens long, known long, grams long, spread array<long>")
    total = parts.agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "grams")], *[F.sum(F.col("spread")[i]).alias(f"spread{i}") for i in range(5)]).first()
    number = lambda k: int(total[k] or 0)
    discount, spread = _sums(spark, folder, order, shards)
    return {
        "folder": folder, "order": order, "shards": shards, "hot": hot, "hot_stats": spread, "discount": discount,
        "tokens": number("tokens"), "known": number("known"), "grams": number("grams"),
        "lower": discounts(*(number(f"spread{i}") for i in range(4))), "spread": [number("spread0"), number("spread1"), number("spread4")],
    }


def run_of(shards: int) -> int:
    """Tokens scored at a time. Each run opens every shard it needs once, so runs grow with the shards: what a token costs stays the same.

    Beyond MOST_RUN / PER_SHARD shards (a few dozen GB of text) the share of opening grows again.
    """
    return min(max(MOST_RUN, SCORE_RUN), max(SCORE_RUN, PER_SHARD * shards))


class Model:
    """Looks up sequences in the mapped arrays, one shard at a time: no more than one shard is held, and of each token only its probabilities."""

    def __init__(self, spec: dict):
        self.spec = spec
        lower, grams = spec["lower"], max(spec["grams"], 1)
        self.spare = float(np.dot(lower[1:], spec["spread"])) / grams

    def _each_shard(self, kind: str, shard: np.ndarray):
        """For each shard asked: its arrays and which queries go there."""
        order = np.argsort(_small(shard), kind="stable")
        shard = shard[order]
        cuts = np.concatenate([_runs(shard), [len(shard)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield _unpack(map_file(f"{self.spec['folder']}/{kind}-{shard[a]}")), order[a:b]

    def words(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is known, its base log10 probability, and its probability without a history."""
        spec = self.spec
        grams, spare = max(spec["grams"], 1), (self.spare if spec["grams"] else 1.0) / (spec["known"] + 1)
        known, base, p = np.zeros(len(word), bool), np.zeros(len(word)), np.zeros(len(word))
        for (keys, counts, befores), own in self._each_shard("words", word_shard(word, spec["shards"])):
            count, before = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, word[own]), len(keys) - 1)
                hit = keys[at] == word[own]
                count[hit], before[hit] = counts[at[hit]], befores[at[hit]]
            known[own] = count > 0
            base[own] = np.log10((count + 0.1) / (spec["tokens"] + 0.1 * (spec["known"] + 1)))
            p[own] = np.maximum(before - spec["lower"][np.minimum(before, 3)], 0) / grams + spare
        return known, base, p

    def interpolate(self, size: int, history: np.ndarray, token: np.ndarray, p: np.ndarray) -> None:
        """Turn ``p``, the probability under the next lower order, into the one under this order."""
        spec, d = self.spec, self.spec["discount"][size]
        hot, hot_stats = spec["hot_stats"][size]
        for held, own in self._each_shard(f"grams-{size}", history_shard(history, token, spec["hot"][size], spec["shards"])):
            here = history[own]
            n, stats = np.zeros(len(own), np.int64), np.zeros((len(own), STATS), np.int64)
            at = find(held[0], held[1], extend(here, token[own]))
            n[at >= 0] = widen(held[2:5], at[at >= 0])
            at = find(held[5], held[6], here)
            stats[at >= 0] = decoded(held[7:11], at[at >= 0], STATS)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, here), len(hot) - 1)
                hit = hot[at] == here
                stats[hit] = hot_stats[at[hit]]
            seen = np.maximum(n - d[np.minimum(n, 3)], 0)
            p[own] = np.where(stats[:, 0] > 0, (seen + (stats[:, 1:] @ d[1:]) * p[own]) / np.maximum(stats[:, 0], 1), p[own])

    def score(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Per stretch: tokens, known tokens, base log10 probability, model's log10 probability."""
        order = self.spec["order"]
        flat, at, size = grams_of(parts, order)
        token = flat[at]
        known, base, p = self.words(token)
        for k in range(2, order + 1):
            self.interpolate(k, sequence_key([flat[at - j] for j in range(k - 1, 0, -1)]), token, p)
        cut = lambda x: np.add.reduceat(np.append(x, x[:1] * 0), np.cumsum(size) - size) * (size > 0)
        return [size, cut(known.astype(np.int64)), cut(base), cut(np.log10(p))]


def score(docs: DataFrame, spec: dict) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10) and ``perplexity``."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    most = run_of(spec["shards"])

    def run(batches):
        model = Model(shared.value)
        order = shared.value["order"]
        ids, parts, owner, held = [], [], [], 0
        sums = np.zeros((0, 4))

        def add():
            own = np.zeros((len(ids), 4))
            own[: len(sums)] = sums
            for c, x in enumerate(model.score(parts)):
                np.add.at(own[:, c], owner, x)
            return own

        def rows(n):
            size, known, base, own = (sums[:n, c] for c in range(4))
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids[:n], pa.int64()), "n_tokens": pa.array(size.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array([shared.value["tokens"]] * n, pa.int64()),
                "base_score": pa.array(base), "score": pa.array(own), "perplexity": pa.array(10.0 ** np.minimum(-own / size, 300.0)),
            })

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                for part in stretches(text.as_py(), order):
                    parts.append(part)
                    owner.append(len(ids) - 1)
                    held += len(part)
                    if held >= most:
                        sums = add()
                        done = len(ids) - 1  # the last text may go on
                        if done:
                            yield rows(done)
                        ids, sums = ids[done:], sums[done:]
                        parts, owner, held = [], [], 0
        if parts:
            sums = add()
        if ids:
            yield rows(len(ids))

    ddl = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def language_model_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The operator over a table of texts: train outside the held-out fold, score every row."""
    spec = train(docs.where(~held_out()), order)
    return score(docs, spec).withColumn("held_out", held_out())
