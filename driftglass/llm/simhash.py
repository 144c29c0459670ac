"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints that differ in at most three bits have one
segment that differs in at most one bit, so they share a one-wildcard variant of that segment: the segment with one
named bit blanked. Each distinct fingerprint gets 64 such keys; equal keys meet by a shuffle, and every meeting is
verified by the number of differing bits. A task emits, for the links found in a batch, a star per component rather
than pairs, so a group of n near copies yields at most n rows; components are then joined up across tasks.

For texts with a similarity (Jaccard, distinct shingles of five words) of 0.8 or more (``decisions``) bits alone neither find nor decide:
at 0.8 some 15 % of the bits differ. There a signature has ``SEGMENTS`` segments of 16 bits, and beside each the smallest of
the shingles' hashes under an order of the segment's own. A key is a one-wildcard variant of a segment together with that smallest hash, so
only texts that share a shingle can meet: with J and p the share of differing bits, a segment brings two texts together with a chance of
J * ((1-p)^16 + 16 p (1-p)^15), about 0.22 at 0.8, and one of twelve does with 0.95. Segments whose smallest hash no other text has make no
keys. What met is verified on the shingles themselves: no pair below the similarity links.

Where keys lead to no meeting, or a large key compares its members with one of them only, an exact search makes up for it: all shingles are put in one
order, rare ones first, and each set is known by its ``head``, so many of its first shingles that two sets of the similarity share one. Sets of
different components that share a shingle of their heads are compared, unless sizes, parities or the number of shingles shared rule it out; so no link between components is lost.
Of all pairs, however found, texts are fetched only where the sketches of both sets (size and parities) leave the similarity possible.

A key with more than ``LIMIT`` fingerprints isn't worked off in one task: its members are dealt into blocks, and each
pair of blocks becomes a group of its own, so the check stays exact and spreads over the cluster.

Defined cases: null texts and texts without a word have fingerprint zero and link like any other; exact copies share
one fingerprint and enter the search once; very long texts are hashed ``RUN`` shingles at a time; a bit set in just half of the
hashes is not set; repeated rows each get their row; an empty table gives none; documents with a null id get the smallest
id of their component, null if it has none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.common import connected_components, local_roots, materialize, mix64, slices

WORDS = 3
BITS = 3
TEXT_WORDS = 5
SIMILARITY = (4, 5)  # shared shingles to all, as a fraction
SEGMENTS = 12
SAMPLE = (16, 2048)  # one text of so many, but so many texts at least, say which shingles are frequent; this decides an order, not what is compared
FREQUENT = (2, 1 << 20)  # texts of the sample that have it, and so many shingles at most
PLACES = 1 << 24  # bits that say which texts are asked for
FEW = 8  # members of a key that are compared pair by pair
LIMIT = 4096
BLOCK = 2048
SEED = 42
RUN = 1 << 16


def majority(text: str | None, width: int, digest, bits: int) -> bytes | None:
    """A bit is set if it is set in over half of the hashes of the shingles of ``width`` words; None for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return None
    if len(words) <= width:
        starts, ends = [0], [sum(map(len, words)) + len(words) - 1]
    else:
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], after[:-width]]).tolist()
        ends = (after[width - 1 :] - 1).tolist()
    joined = b" ".join(words)
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(starts), RUN):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + RUN], ends[at : at + RUN], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, bits).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def fingerprint(text: str | None, width: int = WORDS) -> int:
    """Signed 64-bit fingerprint, zero for a text without words."""
    return int.from_bytes(majority(text, width, xxhash.xxh64_digest, 64) or bytes(8), "big", signed=True)


def fingerprints(docs: DataFrame, *more: str, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``fp`` and the long columns ``more`` of every row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fps, pa.int64())} | {n: batch.column(n) for n in more})

    return docs.select("doc_id", "text", *more).mapInArrow(run, ", ".join(f"{n} long" for n in ("doc_id", "fp", *more)))


def variants(fps: DataFrame) -> DataFrame:
    """64 rows ``key``, ``fp`` per distinct fingerprint: segment, blanked bit and what is left of the segment."""
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).selectExpr(
        "(if(k < 32, shiftrightunsigned(fp, 32), fp & 4294967295L) & ~shiftleft(1L, k % 32)) | shiftleft(cast(k AS BIGINT), 32) AS key", "fp"
    )


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _linked(fp: np.ndarray, size: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of consecutive groups: small groups by shifted comparison, large ones by search from member to member."""
    n, first = len(fp), np.concatenate([[0], np.cumsum(size)[:-1]])
    group = np.repeat(np.arange(len(size)), size)
    left, right = [], []
    small = size[group] <= 64
    shift = 1
    while shift < n:
        a = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:])
        if not len(a):
            break
        a = a[differing(fp[a], fp[a + shift]) <= bits]
        left.append(a)
        right.append(a + shift)
        shift += 1
    for g in np.flatnonzero(size > 64):
        own = fp[first[g] : first[g] + size[g]]
        todo = np.arange(len(own))
        while len(todo):
            front, todo = [todo[0]], todo[1:]
            while front and len(todo):
                here = front.pop()
                near = differing(own[todo], own[here]) <= bits
                if near.any():
                    found = todo[near]
                    left.append(np.full(len(found), here + first[g]))
                    right.append(found + first[g])
                    front += found.tolist()
                    todo = todo[~near]
    empty = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def verify(sorted_variants: DataFrame, limit: int | None, bits: int = BITS) -> DataFrame:
    """From rows ``key``, ``fp`` sorted by key in each partition: links ``u``, ``v``. Members of keys over ``limit`` come back with their key, as ``u``."""
    kinds = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64())])

    def stars(fp, size):
        left, right = _linked(fp, size, bits)
        if not len(left):
            return None
        nodes, where = np.unique(np.concatenate([fp[left], fp[right]]).view(np.int64), return_inverse=True)
        root = local_roots(len(nodes), where[: len(left)], where[len(left) :])
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]]), pa.nulls(len(own), pa.int64())], schema=kinds)

    def put_off(key, fp):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(fp).view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(np.full(len(fp), key))], schema=kinds)

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        hot = None

        def work(keys, fps):
            change = np.flatnonzero(np.diff(keys)) + 1
            size = np.diff(np.concatenate([[0], change, [len(keys)]]))
            several = size > 1
            if limit is not None and (size > limit).any():
                for g in np.flatnonzero(size > limit):
                    at = int(size[:g].sum())
                    yield put_off(keys[at], fps[at : at + size[g]])
                several &= size <= limit
            if several.any() and (found := stars(fps[np.repeat(several, size)], size[several])) is not None:
                yield found

        for batch in batches:
            if not batch.num_rows:
                continue
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if hot is not None:
                same = int(np.searchsorted(k, hot, side="right"))
                if same:
                    yield put_off(hot, f[:same])
                    k, f = k[same:], f[same:]
                if not len(k):
                    continue
                hot = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            if last:
                yield from work(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if limit is not None and len(keys) > limit:
                hot = keys[0]
                yield put_off(hot, fps)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from work(keys, fps)

    return sorted_variants.mapInArrow(run, "u long, v long, key long")


def links(fps: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that connect all fingerprints of each component, of column ``fp``."""
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each row becomes 64, so partitions merged by size would be that much too large
    met = variants(fps.repartition(spread)).repartition("key").sortWithinPartitions("key")
    first = materialize(verify(met, LIMIT), "simhash-links")
    waiting = first.where("key is not null").select("key", F.col("u").alias("fp"))
    if waiting.isEmpty():
        return first.select("u", "v")
    counted = waiting.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = waiting.join(counted, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("key", "fp", "own", other).select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    second = verify(pairs.repartition("key").sortWithinPartitions("key"), None)
    return first.where("v is not null").select("u", "v").unionByName(second.select("u", "v"))


def _rooted(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """``fps`` (one row per ``fp``) with ``root``, one fingerprint that names the component."""
    parts = connected_components(edges, "simhash-components")
    return fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id reachable by links."""
    own = materialize(fingerprints(docs, words=words), "simhash-fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = _rooted(fps, links(fps.select("fp")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- texts by similarity ----------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int = TEXT_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text (lower-cased A-Z); of the whole sequence where words are fewer, of nothing without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(joined, SEED)], np.uint64)
    after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.concatenate([[0], after[:-width]]).tolist(), (after[width - 1 :] - 1).tolist()
    digest = xxhash.xxh3_64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]), ">u8").astype(np.uint64))


def orders(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(hashes: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """The majority bits of the hashes in segments of 16, and for each segment the smallest hash under its own order."""
    words = -(-segments // 4)
    ones, low = np.zeros(64 * words, np.int64), np.full(segments, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), RUN):
        own = hashes[at : at + RUN]
        wide = np.stack([mix64(own + x) for x in orders(words + segments)[segments:]], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), bitorder="little").reshape(len(own), -1).sum(0, dtype=np.int64)
        low = np.minimum(low, [mix64(own ^ x).min() for x in orders(segments)])
    bits = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u2")[:segments]
    return bits.astype(np.int64), low.astype(np.uint64).view(np.int64)


def frequent(docs: DataFrame, words: int = TEXT_WORDS) -> np.ndarray:
    """Hashes of shingles that several texts of a sample have, the more frequent later.

    The sample grows with the texts, so a shingle that as many texts have is as likely to be known in a larger table, and keys that
    are no part of this list don't have more members there. Where the list would be too long, all of the least counts are left out.
    """
    every = min(SAMPLE[0], max(1, docs.count() // SAMPLE[1]))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found = [shingle_hashes(x.as_py(), words) for x in batch.column(0)]
            if found:
                yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(found).view(np.int64)})

    counted = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    counted = materialize(counted.where(F.col("n") >= FREQUENT[0]), "simhash-frequent")
    least, total = None, 0
    for n, shingles in counted.groupBy("n").agg(F.count("*")).orderBy(F.desc("n")).collect():
        total += shingles
        if total > FREQUENT[1]:
            break
        least = n
    if least is None:
        return np.empty(0, np.uint64)
    rows = counted.where(F.col("n") >= least).toArrow()
    shingle, n = (rows[c].to_numpy() for c in ("shingle", "n"))
    return shingle[np.lexsort((shingle, n))].view(np.uint64)


def head_of(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, least: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The first of the sorted ``hashes``, by ``rank`` those among the sorted ``common`` last, so many that similar sets share one of them."""
    n = len(hashes)
    length = n + least[0] * -n // least[1] + 1  # a similar set has all but n - ceil(n * similarity)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = common[at] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late][np.argsort(rank[at[late]])]])
    return hashes[:length].view(np.int64)


def parities_of(hashes: np.ndarray) -> np.ndarray:
    """Bits, a power of two and as many as hashes or 64 at least, each the parity of the number of hashes that end in its place's bits: those of two sets differ in no more places than the sets have shingles one without the other."""
    places = 1 << max(6, (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(parities: np.ndarray, words: int) -> np.ndarray:
    """What fewer places would have held, 64 a word."""
    return np.bitwise_xor.reduce(parities.reshape(-1, words), axis=0)


def parity_of(hashes: np.ndarray) -> int:
    """The same in 64 bits, by the last six bits of the hashes."""
    return int(folded(parities_of(hashes), 1)[0])


def sketch_of(hashes: np.ndarray) -> bytes:
    """The number of the hashes and their parities."""
    return np.concatenate([[len(hashes)], parities_of(hashes)]).astype("<i8").tobytes()


SIGNED = "doc_id long, text_hash long, node long, bits array<long>, low array<long>, n long, parity long, sketch binary, head array<long>"


def signatures(docs: DataFrame, words: int = TEXT_WORDS, segments: int = SEGMENTS, least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (names the set of shingles; 0 without words), ``bits``, ``low`` and ``head`` (null without words), the number ``n`` of shingles, their ``parity`` and ``sketch`` of every row."""
    last = frequent(docs, words)
    by_hash = np.argsort(last).astype(np.int32)
    given = docs.sparkSession.sparkContext.broadcast((last[by_hash], by_hash))

    def run(batches):
        common, rank = given.value
        for batch in (part for whole in batches for part in slices(whole, "text")):
            nodes, bits, low, size, parity, sketch, heads = [], [], [], [], [], [], []
            for text in batch.column(1):
                own = shingle_hashes(text.as_py(), words)
                b, m = signature(own, segments) if len(own) else (None, None)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else 0)
                bits.append(b)
                low.append(m)
                size.append(len(own))
                parity.append(parity_of(own))
                sketch.append(sketch_of(own))
                heads.append(head_of(own, common, rank, least) if len(own) else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "text_hash": batch.column(2), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)),
                "bits": pa.array(bits, pa.list_(pa.int64())), "low": pa.array(low, pa.list_(pa.int64())),
                "n": pa.array(size, pa.int64()), "parity": pa.array(parity, pa.int64()), "sketch": pa.array(sketch, pa.binary()), "head": pa.array(heads, pa.list_(pa.int64())),
            })

    return docs.select(F.col("doc_id").cast("long"), "text", "text_hash").mapInArrow(run, SIGNED)


def shared_only(rows: DataFrame, key: str, most: int = LIMIT) -> DataFrame:
    """Rows whose ``key`` occurs more than once. Keys with over ``most`` rows, and over a thousandth of all, are a broadcast list of less than a thousand."""
    counted = materialize(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "simhash-shared")
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(most, total // 1000)
    many, others = F.broadcast(counted.where(hot).select(key)), counted.where(~hot).select(key)
    few = asked(rows.join(many, key, "left_anti"), others, [key]).join(others, key)  # a semi join would be done before the bits are looked up
    return rows.join(many, key, "left_semi").unionByName(few.select(rows.columns))


def keys(nodes: DataFrame) -> DataFrame:
    """Rows ``key``, ``node``, ``fp``: one-wildcard variants of segments with their smallest hash, where another node has that hash; ``fp`` has the first four segments."""
    fp = F.expr("shiftleft(bits[0], 48) | shiftleft(bits[1], 32) | shiftleft(bits[2], 16) | bits[3]").alias("fp")
    each = nodes.where("bits is not null").select("node", fp, F.posexplode(F.arrays_zip("bits", "low")).alias("segment", "x"))
    each = each.select("node", "fp", F.xxhash64("segment", "x.low").alias("met"), F.col("x.bits").alias("bits"))
    again = materialize(shared_only(each, "met"), "simhash-segments")
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wild = again.repartition(spread).select("node", "fp", "met", "bits", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return wild.select(F.expr("xxhash64(met, k, bits & ~shiftleft(1L, k))").alias("key"), "node", "fp")


def pivot_of(nodes: np.ndarray, fps: np.ndarray) -> int:
    """The place of the member nearest to the bits that most members have: of copies of one text, as a rule that text. Ties go to the smallest node."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")
    usual = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(fps), bitorder="little").view(np.uint64)[0]
    return int(np.lexsort((nodes, np.bitwise_count(fps ^ usual)))[0])


def meetings(keyed: DataFrame) -> DataFrame:
    """Pairs ``u``, ``v`` of nodes with one key: all of up to FEW members, else each with their pivot, BLOCK by BLOCK, a pivot being a member of the next block.

    Keys of one cluster of copies choose much the same pivots, so distinct pairs stay in proportion to the members. Members that are alike, but not like
    their pivot, are left to ``crossings``.
    """

    def run(batches):
        now, nodes, fps = None, [], []
        found, held = [], 0

        def flush():
            u, v, key = (np.concatenate([x[i] for x in found]) for i in range(3))
            rows = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v), key], axis=1), axis=0)
            _, at = np.unique(rows[:, :2], axis=0, return_index=True)
            return pa.RecordBatch.from_pydict({"u": rows[at, 0], "v": rows[at, 1], "salt": rows[at, 2]})

        def close():
            """Pairs of the block at hand, and its pivot."""
            own, at = np.unique(np.array(nodes, np.int64), return_index=True)
            if len(own) < 2:
                return 0, 0
            if len(own) <= FEW:
                a, b = np.triu_indices(len(own), 1)
                found.append((own[a], own[b], np.full(len(a), now)))
                return len(a), int(at[0])
            pivot = pivot_of(own, np.array(fps, np.int64).view(np.uint64)[at])
            found.append((np.delete(own, pivot), np.full(len(own) - 1, own[pivot]), np.full(len(own) - 1, now)))
            return len(own), int(at[pivot])

        for batch in batches:
            for key, node, fp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != now:
                    held += close()[0]
                    now, nodes, fps = key, [], []
                nodes.append(node)
                fps.append(fp)
                if len(nodes) == BLOCK:
                    n, pivot = close()
                    held += n
                    nodes, fps = [nodes[pivot]], [fps[pivot]]
                if held > RUN:
                    yield flush()
                    found, held = [], 0
        held += close()[0]
        if held:
            yield flush()

    met = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long, salt long")
    return met.groupBy("u", "v").agg(F.min("salt").alias("salt"))


def compared(pairs: DataFrame, held: DataFrame, alike) -> DataFrame:
    """Those of the pairs ``u``, ``v``, ``salt`` that are ``alike`` by the words of 64 bits that ``held`` has of each ``node``. Each ``v`` meets its partners of one ``salt`` in one run, and travels once for them."""
    name = next(c for c in held.columns if c != "node")
    partners = pairs.join(held.withColumnRenamed("node", "u"), "u").selectExpr("v", "salt", "1 role", "u node", f"{name} held")
    pivots = pairs.select("v", "salt").distinct().join(held.withColumnRenamed("node", "v"), "v").selectExpr("v", "salt", "0 role", "v node", f"{name} held")

    def run(batches):
        pivot = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for v, salt, role, node, words in zip(*(batch.column(c).to_pylist() for c in ("v", "salt", "role", "node", "held")), strict=True):
                own = np.frombuffer(words, "<u8")
                if role == 0:
                    pivot = own
                elif alike(own, pivot):
                    found.append((node, v, salt))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["u", "v", "salt"])

    met = partners.unionByName(pivots).repartition("v", "salt").sortWithinPartitions("v", "salt", "role")
    return met.mapInArrow(run, "u long, v long, salt long")


def similar(pairs: DataFrame, sets: DataFrame, least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Those of the pairs ``u``, ``v`` whose sets of shingles are similar."""

    def alike(a, b):
        short, long = (a, b) if len(a) < len(b) else (b, a)
        at = np.minimum(np.searchsorted(long, short), len(long) - 1)
        both = int((long[at] == short).sum())
        return least[1] * both >= least[0] * (len(a) + len(b) - both)

    return compared(pairs, sets, alike).select("u", "v")


def possible(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs ``u``, ``v``, ``salt`` but those that sizes and parities of their sets rule out: similar sets have few shingles one without the other."""

    def alike(a, b):
        short, long = sorted((int(a[0]), int(b[0])))
        if least[0] * long > least[1] * short:
            return False
        words = min(len(a), len(b)) - 1
        apart = int(np.bitwise_count(folded(a[1:], words) ^ folded(b[1:], words)).sum())
        return (least[0] + least[1]) * apart <= (least[1] - least[0]) * (short + long)

    involved = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    return compared(pairs, materialize(asked(nodes.select("node", "sketch"), involved, ["node"]), "simhash-sketches"), alike)


def asked(docs: DataFrame, reps: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``docs`` that ``reps`` has by these columns, and few others: what a join with ``reps`` needs to shuffle. The broadcast is a bit for each of PLACES hashes."""
    place = F.pmod(F.xxhash64(*names), F.lit(PLACES))
    placed = lambda df, more: df.select(*more, F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    maps = placed(reps, []).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.expr("cast(conv(hex(substring(map, cast(shiftright(bit, 3) AS INT) + 1, 1)), 16, 10) AS BIGINT)")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1L, cast(bit % 8 AS INT))")) != 0
    return placed(docs, docs.columns).join(F.broadcast(maps), "bucket").where(is_set).select(docs.columns)


def shingle_sets(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """``node`` and its ``shingles``, from the text of one row for each."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "shingles": pa.array([shingle_hashes(x.as_py(), words).tobytes() for x in batch.column(1)], pa.binary())})

    names = ["doc_id", "text_hash"]
    own = asked(docs, reps, names).dropDuplicates(names).join(reps, names)  # repeated rows go before the join, so the sets needn't be shuffled
    return own.select("node", "text").mapInArrow(run, "node long, shingles binary")


def shared_heads(own: DataFrame) -> DataFrame:
    """Rows ``key``, ``node``: shingles of heads that several nodes have there, each node once."""

    def run(batches):
        now, before, told = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (batch.column(i).to_numpy() for i in range(2))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            new[0] = (key[0], node[0]) != (now, before)
            if not new.any():
                continue
            waiting = now is not None and not told  # the last row of the batches before is held back until its key is seen again
            key, node = key[new], node[new]
            again = key[1:] == key[:-1]
            out = np.zeros(len(key), bool)
            out[1:] |= again
            out[:-1] |= again
            out[0] |= key[0] == now
            if waiting and key[0] == now:
                yield pa.RecordBatch.from_pydict({"key": np.array([now], np.int64), "node": np.array([before], np.int64)})
            now, before, told = key[-1], node[-1], bool(out[-1])
            yield pa.RecordBatch.from_pydict({"key": key[out], "node": node[out]})

    rows = own.where("head is not null").select(F.explode("head").alias("key"), "node")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def crossings(shared: DataFrame, least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Pairs ``u``, ``v`` of different ``part`` that may be similar, from rows ``key``, ``node``, ``n``, ``parity``, ``part``: all that share a key and whose sizes, parities and number of keys allow it."""
    counted = shared.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low <> high")
    dealt = shared.join(counted.select("key", "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    rows = dealt.select("*", other).select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "n", "parity", "part")

    def work(key, node, n, parity, part):
        at, shift = np.arange(len(key)), 1
        while len(at := at[at + shift < len(key)]):  # members come by size, so what is too large now is too large further on
            to = at + shift
            fits = (key[to] == key[at]) & (least[0] * n[to] <= least[1] * n[at])
            at, to = at[fits], to[fits]
            apart = part[at] != part[to]
            apart &= (least[0] + least[1]) * np.bitwise_count((parity[at] ^ parity[to]).view(np.uint64)).astype(np.int64) <= (least[1] - least[0]) * (n[at] + n[to])
            x, y = at[apart], to[apart]
            if len(x):
                u, v = node[x], node[y]
                yield pa.RecordBatch.from_pydict({"u": np.maximum(u, v), "v": np.minimum(u, v), "short": n[x], "long": n[y]})
            shift += 1

    def run(batches):
        held = [np.empty(0, np.int64)] * 5
        for batch in batches:
            held = [np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(held)]
            if len(held[0]):
                done = int(np.searchsorted(held[0], held[0][-1]))
                yield from work(*(a[:done] for a in held))
                held = [a[done:] for a in held]
        yield from work(*held)

    met = rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(run, "u long, v long, short long, long long")
    met = met.groupBy("u", "v", "short", "long").agg(F.count("*").alias("keys"))
    a, b = least  # what both share is among the keys, or behind the head of the one whose head ends first
    return met.where(f"{a + b} * (keys + ceil({a} * long / {b}) - 1) >= {a} * (short + long)").select("u", "v")


def sets_of(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    involved = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    reps = materialize(nodes.join(involved, "node").select("node", "low_row.*"), "simhash-rows")  # its size decides whether the texts have to be shuffled
    return materialize(shingle_sets(texts, reps, words), "simhash-sets")


def settled(pairs: DataFrame, sets: DataFrame, known: DataFrame | None, least: tuple[int, int]) -> DataFrame:
    """Verified links, enough to connect what the pairs ``u``, ``v``, ``salt`` do: a pair within a component that is connected already isn't looked at."""
    one = pairs.groupBy("u").agg(F.min_by(F.struct("v", "salt"), F.xxhash64("v")).alias("x")).select("u", "x.*")
    first = materialize(similar(one, sets, least), "simhash-similar")
    parts = connected_components(first if known is None else first.unionByName(known), "simhash-parts")
    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    open_ = pairs.join(one.select("u", "v"), ["u", "v"], "left_anti").join(side("u"), "u", "left").join(side("v"), "v", "left")
    rest = materialize(open_.where("coalesce(u_part, u) <> coalesce(v_part, v)").select("u", "v", "salt"), "simhash-open")
    return materialize(first.unionByName(similar(rest, sets, least)), "simhash-settled")


def similar_links(texts: DataFrame, own: DataFrame, nodes: DataFrame, words: int = TEXT_WORDS, least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Verified links ``u``, ``v`` that connect all ``nodes`` that are similar: first of those that met, then of all that are in different components still."""
    pairs = materialize(possible(materialize(meetings(keys(nodes)), "simhash-meetings"), nodes, least), "simhash-pairs")
    found = settled(pairs, sets_of(pairs, texts, nodes, words), None, least)
    parts = connected_components(found, "simhash-parts")
    shared = shared_heads(own).join(nodes.select("node", "n", "parity"), "node").join(parts, "node", "left")
    apart = crossings(materialize(shared.select("key", "node", "n", "parity", F.coalesce("component", "node").alias("part")), "simhash-heads"), least)
    apart = materialize(apart.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(8))), "simhash-crossings")
    apart = materialize(possible(apart, nodes, least), "simhash-apart")
    if apart.isEmpty():
        return found
    sets = sets_of(apart, texts, nodes, words)
    more = similar(apart, sets, least) if apart.count() <= RUN else settled(apart, sets, found, least)
    return found.unionByName(more)


def decisions(docs: DataFrame, words: int = TEXT_WORDS, least: tuple[int, int] = SIMILARITY, segments: int = SEGMENTS) -> DataFrame:
    """``doc_id``, ``text_hash`` (xxhash64 of the text) and ``first`` of the rows a choice of one per component is about, by similarity of texts.

    ``first`` is false for rows behind the first of their component by these two columns; it is true for those that are first and occur more than once.
    Rows without an id take no part. Texts without words are one component.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    own = materialize(signatures(texts, words, segments, least), "simhash-signatures")
    nodes = own.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("low_row"), F.min(F.struct("bits", "low", "n", "parity", "sketch")).alias("x")).select("node", "low_row", "x.*")
    nodes = materialize(nodes, "simhash-nodes")
    rooted = _rooted(nodes.select(F.col("node").alias("fp"), F.col("low_row").alias("low")), similar_links(texts, own, nodes, words, least))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("lowest"))
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "lowest")
    rows = own.groupBy("doc_id", "text_hash", F.col("node").alias("fp")).agg(F.count("*").alias("n"))
    found = rows.join(named, "fp").select("doc_id", "text_hash", F.expr("struct(doc_id, text_hash) = lowest").alias("first"), "n").where("not first or n > 1")
    return materialize(found.drop("n"), "simhash-decisions")
