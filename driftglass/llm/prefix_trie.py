"""Conversation prefix trie: digest-keyed parent edges, rolled up to all ancestors by pointer jumping.

1. Turns are numbered by a range-partitioned sort, so that one conversation may spread over many tasks; where it does, the
   part in each partition starts from the number of turns before it.
2. A conversation is rebuilt from the head of another one and its own later turns. A prefix is named by the sum of the digests of its
   turns, each taken with its position (four lanes of 40 bits of SHA-256, and the length), so names are running sums: within
   blocks of ``BLOCK`` turns, and over the totals of a conversation's earlier blocks where it has several.
3. Nodes are the distinct names; an edge leads from a prefix to the one that is a turn shorter.
4. In round k every node that has an ancestor 2^k above passes its sums to it and then points twice as far. Rounds are as
   many as the logarithm of the depth, and only nodes that still point somewhere take part.

Hot keys: rows of a node are added up before they are shuffled. Where over ``HOT`` nodes (and over a ``MOST_HOT``-th of them) point
to one, it is looked up from a broadcast list of at most ``MOST_HOT`` such nodes, all others by a join. The ids that end at one node are joined
in chunks by range, then hashed chunk by chunk, so no task holds them.

Defined cases: rows without conv_id belong to no conversation; a null turn sorts first; equal turns are ordered by the digest of role and
text, and repeated rows are repeated turns; a null role or text is empty, as a role or text is; a very long text is reduced to a digest and a number of
words before any shuffle; an empty table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftglass.llm.common import materialize

EVERY = 20  # conversations that share a base
MOST_HEAD = 3
BLOCK = 1024
HOT = 4096
CHUNK = 1 << 17  # ids joined at a time
MOST_HOT = 500
LANES = tuple(f"lane{i}" for i in range(4))
MASK = (1 << 40) - 1
ROOT = b""
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def n_words(text: str) -> Column:
    return F.size(F.filter(F.split(text, WORD_GAP), lambda x: x != "")).cast("long")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their ``place`` (partition of the sort) and ``local`` number there; and by (place, conv_id) the turns ``before`` and in ``total``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    role = F.coalesce(F.col("role"), F.lit("")).cast("binary")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text), 256))
    plain = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), n_words("text").alias("words"))
    plain = plain.withColumn("words", F.greatest("words", F.lit(0)))  # a null text has size -1
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]

    def count(batches):
        place, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            index = np.arange(len(conv))
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            local = index - np.maximum.accumulate(np.where(new, index, 0)) + 1
            if not new[0]:
                local[: int(np.argmax(new)) if new.any() else len(conv)] += n
            last, n = conv[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), place, np.int64)), pa.array(local)], names=["conv_id", "digest", "words", "place", "local"])

    sorted_ = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words")
    rows = materialize(sorted_.mapInArrow(count, "conv_id long, digest binary, words long, place long, local long"), "trie-turns")
    own = Window.partitionBy("conv_id")
    parts = rows.groupBy("conv_id", "place").agg(F.count("*").alias("n"))
    before = F.sum("n").over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows, materialize(parts.select("conv_id", "place", before.alias("before"), F.sum("n").over(own).alias("total")), "trie-parts")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv_id``, ``position``, ``length``, ``digest``, ``words``; and conversations ``conv_id``, ``length``."""
    rows, parts = numbered(turns)
    early = rows.where(f"local <= {MOST_HEAD}").join(parts.where(f"before < {MOST_HEAD}"), ["conv_id", "place"]).withColumn("rank", F.expr("before + local"))
    firsts = early.where(f"rank <= {MOST_HEAD}").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "digest", "words"))).alias("firsts"))
    convs = parts.where("before = 0").select("conv_id", "total").withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1))
    based = convs.withColumn("base", F.expr(f"conv_id - conv_id % {EVERY}")).join(firsts.withColumnRenamed("conv_id", "base"), "base", "left")
    based = based.withColumn("head", F.expr("if(firsts is null, array(), slice(firsts, 1, cast(h as int)))")).withColumn("skip", F.expr("h - size(head)"))
    known = materialize(based.selectExpr("conv_id", "h", "head", "skip", "size(head) + greatest(total - h, 0L) length"), "trie-conversations")
    heads = known.select("conv_id", "length", F.explode("head").alias("x")).selectExpr("conv_id", "x.rank position", "length", "x.digest", "x.words")
    own = parts.select("conv_id", "place", "before").join(known.select("conv_id", "h", "skip", "length"), "conv_id")
    later = rows.join(own, ["conv_id", "place"]).where("before + local > h").selectExpr("conv_id", "before + local - skip position", "length", "digest", "words")
    return heads.unionByName(later), known.select("conv_id", "length")


def edges(turns: DataFrame) -> DataFrame:
    """For each rebuilt turn: ``conv_id``, names of its prefix (``node``) and of the one before (``parent``), ``depth``, ``words`` and whether it ends there."""
    whole = F.sha2(F.concat(F.col("digest"), F.col("position").cast("string").cast("binary")), 256)
    own = turns.select("conv_id", "position", "length", "words", F.expr(f"(position - 1) div {BLOCK} block"), *[F.conv(F.substring(whole, 1 + 10 * i, 10), 16, 10).cast("long").alias(x) for i, x in enumerate(LANES)])
    running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    summed = materialize(own.select("conv_id", "position", "length", "words", "block", *LANES, *[F.sum(x).over(running).alias(f"sum_{x}") for x in LANES]), "trie-sums")
    carried = summed.where(f"length > {BLOCK}")
    if carried.isEmpty():
        named = summed
    else:
        totals = carried.groupBy("conv_id", "block").agg(*[F.max(f"sum_{x}").bitwiseAND(F.lit(MASK)).alias(f"own_{x}") for x in LANES])
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        totals = totals.select("conv_id", "block", *[(F.sum(f"own_{x}").over(earlier) - F.col(f"own_{x}")).alias(f"before_{x}") for x in LANES])
        carried = carried.join(totals, ["conv_id", "block"]).select(*[c for c in summed.columns if not c.startswith("sum_")], *[(F.col(f"sum_{x}") + F.col(f"before_{x}")).alias(f"sum_{x}") for x in LANES])
        named = summed.where(f"length <= {BLOCK}").unionByName(carried)

    def name(at: Column, of) -> Column:
        parts = [F.lpad(F.hex(of(x).bitwiseAND(F.lit(MASK))), 10, "0") for x in LANES]
        return F.when(at == 0, F.lit(ROOT)).otherwise(F.unhex(F.concat(*parts, F.lpad(F.hex(at), 16, "0"))))

    node = name(F.col("position"), lambda x: F.col(f"sum_{x}"))
    parent = name(F.col("position") - 1, lambda x: F.col(f"sum_{x}") - F.col(x))
    return materialize(named.select("conv_id", node.alias("node"), parent.alias("parent"), F.col("position").alias("depth"), "words", F.expr("position = length").alias("ends")), "trie-edges")


def looked_up(rows: DataFrame, key: str, table: DataFrame, given: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows`` joined on ``key`` with ``table`` (one row per key); ``given`` has, per key, how many rows point there (``n``)."""
    total = given.agg(F.sum("n")).first()[0] or 0
    many = given.where(F.col("n") > max(hot, total // MOST_HOT)).select(key)  # fewer than MOST_HOT
    answers = table.join(F.broadcast(many), key).collect()
    if not answers:
        return rows.join(table, key)
    short = F.broadcast(rows.sparkSession.createDataFrame(answers, table.schema))
    return rows.join(F.broadcast(many), key, "left_anti").join(table, key).unionByName(rows.join(short, key))


def rolled_up(nodes: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Per ``node``: sums of ``leaves`` and ``saved`` over its subtree, and ``n_children``; and per parent the number ``n`` of nodes below."""
    children = materialize(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n")), "trie-children")
    own = nodes.join(children, "node", "left").selectExpr("node", "parent to", "if(n is null, 1L, 0L) leaves", "(n_convs - 1) * words saved", "coalesce(n, 0L) n_children")
    own = materialize(own, "trie-own")
    sums = [own.drop("to")]
    active, given = own.where("to is not null").drop("n_children"), None
    while True:
        given = materialize(active.groupBy(F.col("to").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n")), "trie-given")
        sums.append(given.selectExpr("node", "leaves", "saved", "0L n_children"))
        above = active.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = looked_up(active, "to", above, given.select(F.col("node").alias("to"), "n"), hot).select("node", F.col("next").alias("to"), "leaves", "saved")
        more = given.select("node", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        active = materialize(moved.join(more, "node", "left").selectExpr("node", "to", "leaves + coalesce(more_leaves, 0L) leaves", "saved + coalesce(more_saved, 0L) saved"), "trie-active")
        if active.isEmpty():
            break
    whole = sums[0]
    for x in sums[1:]:
        whole = whole.unionByName(x)
    return whole.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "n_children")]), children


def ends_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per ``node``: SHA-256 of the ids that end there, ascending and comma-joined, as they pass in chunks."""

    def join(batches):
        now, ids = None, []

        def out():
            return pa.RecordBatch.from_pydict({"node": pa.array([now], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for node, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (node != now or len(ids) == chunk):
                    yield out()
                    ids = []
                now = node
                ids.append(conv_id)
        if ids:
            yield out()

    def digest(batches):
        now, held, nodes, found = None, None, [], []
        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held is None or node != now:
                    if held is not None:
                        nodes.append(now)
                        found.append(held.hexdigest())
                    now, held = node, hashlib.sha256(ids.as_py().encode())
                else:
                    held.update(b"," + ids.as_py().encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "ends_sha256": pa.array(found, pa.string())})
            nodes, found = [], []
        if held is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([now], pa.binary()), "ends_sha256": [held.hexdigest()]})

    chunks = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(turns: DataFrame, hot: int = HOT) -> DataFrame:
    """Per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256`` and its name ``node``."""
    parts, convs = rebuilt(turns)
    held = edges(parts)
    inner = held.groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = materialize(inner.unionByName(root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))), "trie-nodes")
    sums, children = rolled_up(nodes, hot)
    ends = ends_digests(held.where("ends").select("node", "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("node"), "conv_id")))
    answers = sums.join(ends, "node", "left")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = looked_up(nodes.where("parent is not null"), "parent", above, children.select(F.col("node").alias("parent"), "n"), hot)
    whole = below.unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.join(answers, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "node",
    )
