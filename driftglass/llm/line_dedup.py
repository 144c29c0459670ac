"""Corpus-wide line deduplication by probing a sharded minimal perfect hash instead of joining lines.

A line's key is the line stripped of white space with A-Z lower-cased; keys of at least ``MIN_CHARS`` code points
count. Each task reduces its keys to 128-bit hashes with the number of documents and the smallest and largest doc_id, Spark
adds these up, and all distinct hashes are dealt to shards of about ``SHARD`` entries. Each shard becomes one file in
the shared folder: a minimal perfect hash (bit arrays per level with ranks) that indexes an array of 64-bit
fingerprints and one of counts, a byte each; where a count is over one, the smallest id stands in a list beside them.
Documents then probe the memory-mapped shards; no line is joined or shuffled a second time. Texts are gathered until there are
``PROBES`` lines for each shard, so a shard is opened and searched for many lines at once however many shards there are. Every
shard writes its file, an empty one as well: a missing file is an error. Counts are a byte each, 255 standing for that many and more;
what is dropped depends only on whether a count is over one.

Defined cases: null and empty texts are one empty line, kept as an empty text; white space alone is too short a key;
a line that only repeats within one document stays; very long texts are held one at a time beside a slice of others; rows that share a doc_id count as one document; rows with a null
doc_id count as one further document, larger than all others; an empty table gives no rows; a line that several documents hold stays in the smallest id, in all of its rows. Columns other than the text are kept; ``n_lines`` and ``n_dropped``
in the input are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftglass.llm.common import map_file, materialize, mix64, put_file, shared_path, slices

MIN_CHARS = 10
SHARD = 1 << 18
LEVELS = 40
NO_ID = (1 << 63) - 1
FLUSH = 1 << 19
MAPPED = 4096  # shards that a worker keeps mapped; a mapped shard isn't held in memory
PROBES = 64  # lines that each shard is asked for at a time
GATHERED = 32 << 20  # bytes of texts that are gathered for them at most
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The key of one line of UTF-8, or None if it is too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < MIN_CHARS or (not key.isascii() and len(key.decode()) < MIN_CHARS):
        return None
    return key


def _hashes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _reduced(digests: list[bytes], n: list, low: list, high: list) -> pa.RecordBatch:
    h1, h2 = _hashes(digests)
    n, low, high = (np.concatenate(x) for x in (n, low, high))
    order = np.lexsort((h2, h1))
    h1, h2, n, low, high = (x[order] for x in (h1, h2, n, low, high))
    new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
    return pa.RecordBatch.from_pydict({
        "h1": pa.array(h1[new].view(np.int64)), "h2": pa.array(h2[new].view(np.int64)),
        "n": pa.array(np.add.reduceat(n, new)), "low": pa.array(np.minimum.reduceat(low, new)), "high": pa.array(np.maximum.reduceat(high, new)),
    })


def line_hashes(docs: DataFrame) -> DataFrame:
    """Hashes of the counting keys, added up within each task: ``h1``, ``h2``, ``n`` documents, ``low`` and ``high`` doc_id."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        found: list[bytes] = []
        owners: list[np.ndarray] = []

        def flush():
            ids = np.concatenate(owners)
            return _reduced(found, [np.ones(len(ids), np.int64)], [ids], [ids])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (text := text.as_py()):
                    continue
                own = {digest(k) for x in text.encode().split(b"\n") if (k := line_key(x)) is not None}
                if own:
                    found += own
                    owners.append(np.full(len(own), NO_ID if doc_id is None else doc_id, np.int64))
                if len(found) > FLUSH:
                    yield flush()
                    found, owners = [], []
        if found:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "h1 long, h2 long, n long, low long, high long")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """All hashes ``h1``, ``h2`` with ``n``, the number of rows (1 where all of them share a doc_id), and the smallest id ``low``."""
    summed = line_hashes(docs).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return summed.select("h1", "h2", F.expr("if(low = high, 1L, n)").alias("n"), "low")


def step(level: int) -> np.uint64:
    """What is added to a hash at each level, so that levels place it independently."""
    return np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def build_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, low: np.ndarray) -> bytes:
    """A minimal perfect hash over ``h1`` with the value arrays in its order, as the bytes of one file.

    Level by level, keys that fall alone on a bit of the level's array own it; the others go on. What is left after
    LEVELS (only equal h1) is kept as a plain list behind the arrays.
    """
    offsets, bits, owned = [0], [], []
    todo = np.arange(len(h1))
    for level in range(LEVELS):
        if not len(todo):
            break
        size = max(64, -(-2 * len(todo) // 64) * 64)
        at = mix64(h1[todo] + step(level)) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size)[at.astype(np.int64)] == 1
        mask = np.zeros(size, np.uint8)
        mask[at[alone].astype(np.int64)] = 1
        bits.append(mask)
        owned.append((todo[alone], at[alone].astype(np.int64) + offsets[-1]))
        offsets.append(offsets[-1] + size)
        todo = todo[~alone]
    words = np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64) if bits else np.empty(0, np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    key = np.concatenate([x[0] for x in owned]) if owned else np.empty(0, np.int64)
    place = np.concatenate([x[1] for x in owned]) if owned else np.empty(0, np.int64)
    order = np.concatenate([key[np.argsort(place)], todo])
    counts = np.minimum(counts[order], 255).astype(np.uint8)
    several = np.flatnonzero(counts > 1)
    head = np.array([len(offsets), len(words), len(key), len(todo), len(several)], np.int64)
    parts = [head, np.array(offsets, np.int64), words, ranks, h2[order], h1[todo], several, low[order[several]], counts]
    return b"".join(x.tobytes() for x in parts)


class Shard:
    """One memory-mapped shard."""

    def __init__(self, data: np.ndarray):
        words = data[: len(data) // 8 * 8].view(np.int64)
        levels, n_words, self.n, over, several = (int(x) for x in words[:5])
        at = 5

        def take(n, kind=np.int64):
            nonlocal at
            at += n
            return words[at - n : at].view(kind)

        self.offsets = take(levels).tolist()
        self.words, self.ranks = take(n_words, np.uint64), take(n_words + 1)
        self.fingerprints, self.over = take(self.n + over, np.uint64), take(over, np.uint64)
        self.several, self.low = take(several), take(several)
        self.counts = data[8 * at : 8 * at + self.n + over]

    def kept_in(self, at: np.ndarray) -> np.ndarray:
        """The smallest id of entries whose count is over one."""
        return self.low[np.searchsorted(self.several, at)]

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The index of each hash in the arrays, or -1."""
        found = np.full(len(h1), -1, np.int64)
        todo = np.arange(len(h1))
        for level in range(len(self.offsets) - 1):
            if not len(todo):
                break
            size = self.offsets[level + 1] - self.offsets[level]
            at = (mix64(h1[todo] + step(level)) % np.uint64(size)).astype(np.int64) + self.offsets[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[todo[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(below)
            todo = todo[~hit]
        found[found >= 0] = np.where(self.fingerprints[found[found >= 0]] == h2[found >= 0], found[found >= 0], -1)
        for i, h in enumerate(self.over):
            found[(h1 == h) & (h2 == self.fingerprints[self.n + i])] = self.n + i
        return found


def build_index(docs: DataFrame) -> tuple[str, int]:
    """Write the shards; returns their folder in the shared file system and their number."""
    spark = docs.sparkSession
    lines = materialize(distinct_lines(docs), "line-hashes")
    shards = max(1, -(-lines.count() // SHARD))
    folder = shared_path(spark, "line-index")

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.filter(table.column("n").is_valid())
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        put_file(f"{folder}/{shard}", build_shard(h1, h2, table.column("n").to_numpy(), table.column("low").to_numpy()))
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([table.num_rows], pa.int64())})

    dealt = lines.withColumn("shard", F.pmod("h2", F.lit(shards).cast("long")))
    every = spark.range(shards).select(*[F.lit(None).cast("long").alias(c) for c in lines.columns], F.col("id").alias("shard"))
    dealt.unionByName(every).groupBy("shard").applyInArrow(build, "shard long, n long").agg(F.sum("n")).collect()
    return folder, shards


@lru_cache(maxsize=MAPPED)
def mapped_shard(folder: str, number: int) -> Shard:
    return Shard(map_file(f"{folder}/{number}"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, plus ``n_lines`` (before) and ``n_dropped``."""
    folder, shards = build_index(docs)
    kept = docs.drop("n_lines", "n_dropped")
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def probe(digests, doc, dropped):
        """Mark what goes; ``doc`` has for each digest the id, the place in the gathered texts and the place in its text."""
        h1, h2 = _hashes(digests)
        ids, owner, place = (np.concatenate(x) for x in zip(*doc, strict=True))
        number = (h2.view(np.int64) % shards).astype(np.int64)
        order = np.argsort(number, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(number[order], prepend=-1)), len(order))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[a:b]
            shard = mapped_shard(folder, int(number[own[0]]))
            at = shard.find(h1[own], h2[own])
            if (at < 0).any():
                raise ValueError(f"a line is not in shard {number[own[0]]} of the index")
            several = shard.counts[at] > 1
            own, at = own[several], at[several]
            for j in own[shard.kept_in(at) != ids[own]].tolist():
                dropped[owner[j]].add(int(place[j]))

    def run(batches):
        digest = xxhash.xxh3_128_digest
        held, texts, digests, doc, size = [], [], [], [], 0

        def close():
            dropped: list[set[int]] = [set() for _ in texts]
            if digests:
                probe(digests, doc, dropped)
            at = 0
            for batch in held:
                lines, gone = texts[at : at + batch.num_rows], dropped[at : at + batch.num_rows]
                at += batch.num_rows
                own = {n: batch.column(n) for n in names}
                own["text"] = pa.array([b"\n".join([x for i, x in enumerate(y) if i not in out] if out else y).decode() for y, out in zip(lines, gone, strict=True)], pa.string())
                own["n_lines"] = pa.array(list(map(len, lines)), pa.int64())
                own["n_dropped"] = pa.array(list(map(len, gone)), pa.int64())
                yield pa.RecordBatch.from_pydict(own)

        for batch in (part for whole in batches for part in slices(whole, "text")):
            held.append(batch)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = (text.as_py() or "").encode()
                lines = data.split(b"\n")
                place = []
                for i, x in enumerate(lines):
                    if (k := line_key(x)) is not None:
                        digests.append(digest(k))
                        place.append(i)
                if place:
                    doc.append((np.full(len(place), NO_ID if doc_id is None else doc_id, np.int64), np.full(len(place), len(texts)), np.array(place)))
                texts.append(lines)
                size += len(data)
            if len(digests) >= PROBES * shards or size >= GATHERED:
                yield from close()
                held, texts, digests, doc, size = [], [], [], [], 0
        if held:
            yield from close()

    return docs.mapInArrow(run, schema)
