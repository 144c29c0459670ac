"""Exact deduplication by Grace hash partitioning: complete texts are compared in open-addressing tables that fit in memory.

1. Each task puts its rows into an open-addressing table, a window of bounded bytes and rows at a time. Equal texts of a
   window leave it as one record with the text, their number and their largest id, so a text that many rows share
   travels once per window. All rows are written, each with the number of its record.
2. Records are dealt to buckets by their hash. Buckets whose distinct texts would not fit a table are written to spill files in
   the shared folder and dealt again by further bits, until each fits or holds one hash alone (``spill``).
3. A task reads a bucket as a stream into a table that compares complete texts: it holds each distinct text once and,
   for each record, two numbers. Its answers go back to the rows by the records' numbers.

The hash only decides where a text is looked for. A spill level deals to at most ``FAN`` buckets, so the depth grows with
the logarithm of the input. The records of one text number at most the windows that hold it.

Defined cases: a null text counts as empty; no other change is made to a text. Of equal texts the row with the largest id
stays, null ids being smallest; of rows with that same id and text one, whichever comes first, is kept, the others aren't.
Each row of the input has its row in the result. Very long texts are a window or a bucket of their own. Columns other than the id and the text
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.common import materialize, slices

WINDOW = 32 << 20  # bytes of distinct texts that a task holds before it passes them on
WINDOW_ROWS = 1 << 16
BUCKET = 16 << 20  # bytes of distinct texts, with EACH for every one, that a table is meant for
EACH = 256
FAN = 4096  # buckets that one level deals to
RECORD = "record long, doc_id long, lead boolean, sha binary, hash long, n long, text binary"
ANSWER = "record long, keep_id long, group_size long, wins boolean"


class Table:
    """Open addressing with linear probing; an entry is found only by its complete content."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def add(self, hashed: int, content: bytes) -> int:
        """The entry of ``content``, new if it wasn't there."""
        slots, hashes, contents = self.slots, self.hashes, self.contents
        mask = len(slots) - 1
        i = hashed & mask
        while (e := slots[i]) >= 0:
            if hashes[e] == hashed and contents[e] == content:
                return e
            i = (i + 1) & mask
        slots[i] = e = len(contents)
        hashes.append(hashed)
        contents.append(content)
        if 3 * e > 2 * mask:
            self.grow()
        return e

    def grow(self) -> None:
        self.slots = slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for e, hashed in enumerate(self.hashes):
            i = hashed & mask
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = e


def leading(sha: bytes) -> int:
    """The hash that deals a text: the leading 64 bits of its SHA-256, signed."""
    return int.from_bytes(sha[:8], "big", signed=True)


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_of=leading) -> DataFrame:
    """A row per row: number of its record, id, SHA-256; rows that lead their record also carry hash, number of rows and text."""

    def run(batches):
        number = (TaskContext.get().partitionId()) << 40
        table, ids, entries, shas, held = Table(), [], [], [], 0

        def flush():
            lead, n = [-1] * len(table.contents), [0] * len(table.contents)
            for row, (own, e) in enumerate(zip(ids, entries, strict=True)):
                n[e] += 1
                if lead[e] < 0 or (own is not None and (ids[lead[e]] is None or own > ids[lead[e]])):
                    lead[e] = row
            leads = [lead[e] == row for row, e in enumerate(entries)]
            pick = lambda values: [values[e] if own else None for own, e in zip(leads, entries, strict=True)]
            return pa.RecordBatch.from_pydict({
                "record": pa.array([number + e for e in entries], pa.int64()), "doc_id": pa.array(ids, pa.int64()), "lead": pa.array(leads),
                "sha": pa.array([shas[e] for e in entries], pa.binary()), "hash": pa.array(pick(table.hashes), pa.int64()),
                "n": pa.array(pick(n), pa.int64()), "text": pa.array(pick(table.contents), pa.binary()),
            })

        for batch in (part for whole in batches for part in slices(whole, "text")):
            for own, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = content or b""
                sha = hashlib.sha256(content).digest()
                e = table.add(hash_of(sha), content)
                if e == len(shas):
                    shas.append(sha)
                    held += len(content)
                ids.append(own)
                entries.append(e)
                if held >= WINDOW or len(ids) >= WINDOW_ROWS:
                    yield flush()
                    number += len(shas)
                    table, ids, entries, shas, held = Table(), [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, RECORD)


def spill(todo: DataFrame, bucket: int = BUCKET, fan: int = FAN):
    """Records with ``bucket``, level by level: those whose bucket fits a table, while the rest go to spill files and are dealt again."""
    cost = F.expr(f"length(text) + {EACH}")
    total = todo.agg(F.sum(cost)).first()[0] or 0
    dealt = todo.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(min(fan, 1 + 2 * total // bucket))))
    level = 0
    while True:
        level += 1
        distinct = dealt.groupBy("bucket", "hash").agg(F.max(cost).alias("bytes"))
        over = distinct.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("hashes")).where(f"bytes > {bucket} and hashes > 1")
        over = materialize(over, "grace-over")
        if over.isEmpty():
            yield dealt
            return
        yield dealt.join(over, "bucket", "left_anti")
        again = F.xxhash64("bucket", F.pmod(F.xxhash64("hash", F.lit(level)), F.least(F.lit(fan), 2 + 2 * F.expr(f"bytes div {bucket}"))))
        dealt = materialize(dealt.join(over, "bucket").withColumn("bucket", again).drop("bytes", "hashes"), "grace-spill")


def compare(dealt: DataFrame) -> DataFrame:
    """Answers for the records of whole buckets: ``record``, ``keep_id``, ``group_size`` and whether the row that stays is the record's."""

    def run(batches):
        now, table, records, entries, n, best = None, Table(), [], [], [], []

        def answers():
            return pa.RecordBatch.from_pydict({
                "record": pa.array(records, pa.int64()), "keep_id": pa.array([best[e][1] if best[e][0] else None for e in entries], pa.int64()), "group_size": pa.array([n[e] for e in entries], pa.int64()),
                "wins": pa.array([best[e][2] == -r for r, e in zip(records, entries, strict=True)], pa.bool_()),
            })

        for batch in (part for whole in batches for part in slices(whole, "text")):
            for bucket, record, doc_id, hashed, own, content in zip(*(batch.column(c).to_pylist() for c in ("bucket", "record", "doc_id", "hash", "n", "text")), strict=True):
                if bucket != now:
                    if records:
                        yield answers()
                    now, table, records, entries, n, best = bucket, Table(), [], [], [], []
                e = table.add(hashed, content)
                top = (doc_id is not None, doc_id or 0, -record)
                if e == len(n):
                    n.append(own)
                    best.append(top)
                else:
                    n[e] += own
                    best[e] = max(best[e], top)
                records.append(record)
                entries.append(e)
        if records:
            yield answers()

    own = dealt.select("bucket", "record", "doc_id", "hash", "n", "text")
    return own.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWER)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_of=leading, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """Per row: ``doc_id``, ``keep_id`` (id of the row that stays), ``group_size``, ``kept`` and ``sha`` (of the text, binary)."""
    rows = materialize(records(docs, doc_id, text, hash_of), "grace-records")
    answers = None
    for fitting in spill(rows.where("lead").select("record", "doc_id", "hash", "n", "text"), bucket, fan):
        own = compare(fitting)
        answers = own if answers is None else answers.unionByName(own)
    found = materialize(answers, "grace-answers")
    return rows.select("record", "doc_id", "lead", "sha").join(found, "record").select("doc_id", "keep_id", "group_size", F.expr("lead and wins").alias("kept"), "sha")
