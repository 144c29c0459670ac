"""Alignment of two tokenizers over the same texts by a sweep over the offsets at which their tokens end.

1. ``events``: one pass encodes each row with both tokenizers. The union of their end events is kept in blocks: side, the byte
   offset where the block begins, and ids; as a token's width follows from its id, so do the offsets.
2. Blocks are dealt by row, sorted by offset within partitions and streamed through a machine (``Sweep``) whose state is the group under
   way. At an offset where tokens of both sides end it closes a group; every end event links the two tokens under way before it.
3. ``count_pairs``: each task counts, for the id pairs linked, the rows that hold them, and Spark adds these up. All pairs of an A id go to
   one of ``SHARDS`` sorted arrays in the shared folder, so their number per shard is bounded by the vocabularies. A count that is its A id's highest is marked.
4. ``scored``: rows look their pairs up in the memory-mapped arrays; no row is shuffled a second time.

Defined cases: null and empty texts, and texts that either side's tokens don't spell exactly (as with U+2581), have no tokens: zeros and
an empty ``groups_sha256``. Strings of special tokens inside texts are ordinary text. Each row is a document, also where rows
repeat or share an id; a null id stays. Very long texts travel as many blocks; a group is held whole, as its A ids come before its B
ids. Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.common import map_file, materialize, put_file, shared_path, slices
from driftglass.llm.tokens import DEFAULT, Encoder, load_json, to_bytes

PIECES = "piece_bpe_32k.model"
BLOCK = 1 << 13  # tokens of a block
SHARDS = 256
HELD = 1 << 22  # pairs counted at a time
SPACE = "▁"


class Side:
    """One tokenizer: ids of a text, and the bytes of each id. ``lossless`` ones always spell what they encode, so the number of bytes tells."""

    def __init__(self, encode: Callable[[str], np.ndarray | list[int]], labels: list[bytes], lossless: bool = False):
        self.encode, self.labels, self.lossless = encode, labels, lossless
        self.width = np.array([len(x) for x in labels], np.int64)
        self.kind = np.dtype("<u2" if len(labels) <= 1 << 16 else "<u4")
        digits = len(str(len(labels) - 1))
        text = np.array([str(i).rjust(digits, "\0").encode() for i in range(len(labels))], f"S{digits}")
        self.decimal = text.view(np.uint8).reshape(-1, digits)

    def ids(self, text: str, data: bytes) -> np.ndarray | None:
        """Ids of a text; None if they don't spell ``data``."""
        found = self.encode(text)
        ids = np.asarray(found, self.kind)
        if self.lossless:
            return ids if int(self.width[ids].sum()) == len(data) else None
        return ids if b"".join(map(self.labels.__getitem__, found)) == data else None


def byte_level(content: str) -> Side:
    """A byte-level BPE of a tokenizers file, over a space and the text."""
    spec = json.loads(content)
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        labels[i] = token.encode() if token in special else to_bytes(token)
    encoder = Encoder(content, specials=False)
    plain = spec["normalizer"] is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
    return Side(lambda text: encoder(" " + text).tolist(), labels) if not plain else Side(lambda text: encoder(" " + text), labels, lossless=True)


def pieces(model: bytes) -> Side:
    """A sentencepiece model that puts a space before the text itself."""
    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    labels = [bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace(SPACE, " ").encode() for i in range(p.vocab_size())]
    return Side(p.encode, labels)


class Sides:
    """What makes both sides, shipped to the executors (a few MB, bounded by the vocabularies)."""

    def __init__(self, a: str = DEFAULT, b: str = PIECES):
        self.a = load_json(a)
        with open(b if "/" in b else public_tokenizers.path(b), "rb") as f:
            self.b = f.read()
        self.key = hashlib.sha256(self.a.encode() + self.b).hexdigest()

    def ready(self) -> tuple[Side, Side]:
        if self.key not in _ready:
            _ready[self.key] = byte_level(self.a), pieces(self.b)
        return _ready[self.key]


_ready: dict[str, tuple[Side, Side]] = {}


@lru_cache(maxsize=1)
def packers() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair per worker."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return packers()[0].compress(planes.tobytes())


def expanded(data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(packers()[1].decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


EVENTS = "row long, doc_id long, side int, at long, ids binary"


def events(docs: DataFrame, sides, block: int = BLOCK) -> DataFrame:
    """End events of both sides in blocks; a row without tokens has one block without a side."""

    def run(batches):
        both = sides.value.ready()
        row = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole, "text")):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row += 1
                data = b" " + text.encode() if text else b""
                ids = [s.ids(text, data) for s in both] if text else [None]
                if any(x is None for x in ids):
                    out.append((row, doc_id, None, 0, None))
                    continue
                for side, (s, own) in enumerate(zip(both, ids, strict=True)):
                    begin = np.cumsum(s.width[own]) - s.width[own]
                    out += [(row, doc_id, side, int(begin[k]), squeezed(own[k : k + block])) for k in range(0, len(own), block)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["row", "doc_id", "side", "at", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, EVENTS)


class Sweep:
    """One row's machine. Blocks come in the order of their offsets; what it holds are the tokens of the group under way and those not met yet."""

    def __init__(self, both: tuple[Side, Side]):
        self.both = both
        self.ids = [np.empty(0, np.int64)] * 2
        self.ends = [np.empty(0, np.int64)] * 2
        self.tokens, self.groups, self.links = [0, 0], 0, 0
        self.codes: list[np.ndarray] = []

    def add(self, side: int, at: int, ids: np.ndarray) -> bytes:
        """Take a block in; returns the text of the groups that it closes."""
        ids = ids.astype(np.int64)
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], at + np.cumsum(self.both[side].width[ids])])
        a = self.ends[0]
        every = np.concatenate(self.ends)
        order = np.argsort(every, kind="stable")  # two runs, merged
        every, from_a = every[order], order < len(a)
        again = np.flatnonzero(every[1:] == every[:-1])  # ends on one side differ, so equal neighbours are one of each
        if not len(again):
            return b""
        stop = int(again[-1]) + 2
        every, from_a = every[:stop], from_a[:stop]
        end = np.flatnonzero(np.append(every[1:] != every[:-1], True))
        both_end = np.zeros(stop, bool)
        both_end[again + 1] = True
        cut = both_end[end]
        own_a = np.cumsum(from_a)[end]
        own_b = end + 1 - own_a
        n = [int(own_a[-1]), int(own_b[-1])]
        ida, idb = (self.ids[s][: n[s]] for s in (0, 1))
        for s in (0, 1):
            self.ids[s], self.ends[s] = self.ids[s][n[s] :], self.ends[s][n[s] :]
            self.tokens[s] += n[s]
        # the token under way at an end is the one that ends there, or else the next
        self.codes.append(ida[own_a - (from_a[end] | cut)] * len(self.both[1].labels) + idb[own_b - (~from_a[end] | cut)])
        last = [own_a[cut], own_b[cut]]
        self.groups += len(last[0])
        self.links += len(end)
        group = [np.repeat(np.arange(len(x)), np.diff(x, prepend=0)) for x in last]
        width = max(s.decimal.shape[1] for s in self.both)
        out = np.zeros((n[0] + n[1], width + 1), np.uint8)
        out[:, width] = ord(",")
        place_a = np.arange(n[0]) + np.concatenate([[0], last[1]])[group[0]]
        place_b = np.arange(n[1]) + last[0][group[1]]
        for place, ids_, s in ((place_a, ida, self.both[0]), (place_b, idb, self.both[1])):
            out[place, width - s.decimal.shape[1] : width] = s.decimal[ids_]
        out[place_a[last[0] - 1], width] = ord("|")
        out[place_b[last[1] - 1], width] = ord(";")
        return out[out != 0].tobytes()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the distinct pairs linked, and how often."""
        if not self.codes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.unique(np.concatenate(self.codes), return_counts=True)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def swept(blocks: DataFrame, sides, groups: bool = False) -> DataFrame:
    """Rows with their numbers and packed pairs; also the text of their groups if asked for."""

    def run(batches):
        both = sides.value.ready()
        now, found = None, None

        def close():
            doc_id, machine, sha, text = found
            if any(len(x) for x in machine.ids):
                raise ValueError(f"the tokens of document {doc_id} don't end together")
            codes, times = machine.pairs()
            return (
                doc_id, *machine.tokens, machine.groups, machine.links, sha.hexdigest() if machine.groups else "", squeezed(np.diff(codes, prepend=0)), squeezed(times),
                *([b"".join(text).decode()] if groups else []),
            )

        def batch_of(rows):
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()] + [pa.string()] * groups
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows = []
        for batch in batches:
            for row, doc_id, side, at, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "side", "at")), batch.column("ids"), strict=True):
                if row != now:
                    if found:
                        rows.append(close())
                        if len(rows) == 256:
                            yield batch_of(rows)
                            rows = []
                    now, found = row, (doc_id, Sweep(both), hashlib.sha256(), [])
                if side is not None:
                    _, machine, sha, text = found
                    before = machine.groups
                    own = machine.add(side, at, expanded(ids.as_py(), both[side].kind))
                    if own:  # a group ends with a mark that the last one goes without
                        own = (b";" if before else b"") + own[:-1]
                        sha.update(own)
                        if groups:
                            text.append(own)
        if found:
            rows.append(close())
        if rows:
            yield batch_of(rows)

    schema = ALIGNED + (", groups string" if groups else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return blocks.repartition("row").sortWithinPartitions("row", "at", "side").mapInArrow(run, schema)


CODE = np.dtype("<i8")


def unpacked(codes: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(expanded(codes, CODE)), expanded(times, CODE)


def count_pairs(aligned: DataFrame, size_b: int, shards: int = SHARDS) -> str:
    """Write, by A id, sorted codes and their numbers of rows, negative where that is the A id's highest; returns the folder."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0

        def out():
            codes, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"code": codes, "n": times.astype(np.int64)})

        for batch in batches:
            for codes in batch.column(0):
                held.append(np.cumsum(expanded(codes.as_py(), CODE)))
                n += len(held[-1])
                if n >= HELD:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    folder = shared_path(aligned.sparkSession, "aligned-pairs")

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.filter(table.column("n").is_valid())
        code, n = (table.column(c).to_numpy() for c in ("code", "n"))
        order = np.argsort(code)
        code, n = code[order], n[order]
        new = np.flatnonzero(np.diff(code // size_b, prepend=-1))
        if len(new):
            best = np.repeat(np.maximum.reduceat(n, new), np.diff(np.append(new, len(n))))
            n = np.where(n == best, -n, n)
        put_file(f"{folder}/{shard}", np.concatenate([code, n]).astype(CODE).tobytes())
        return pa.table({"pairs": pa.array([len(code)], pa.int64())})

    counted = aligned.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    dealt = counted.withColumn("shard", F.expr(f"code div {size_b} % {shards}"))
    every = aligned.sparkSession.range(shards).selectExpr("cast(null as long) code", "cast(null as long) n", "id shard")
    dealt.unionByName(every).groupBy("shard").applyInArrow(build, "pairs long").agg(F.sum("pairs")).collect()
    return folder


@lru_cache(maxsize=2 * SHARDS)
def mapped_pairs(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    data = map_file(f"{folder}/{shard}").view(CODE)
    return data[: len(data) // 2], data[len(data) // 2 :]


def scored(aligned: DataFrame, folder: str, size_b: int, shards: int = SHARDS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its pairs."""
    names = [c for c in aligned.columns if c not in ("codes", "times")]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "codes")):
            held = [unpacked(c, t) for c, t in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True)]
            codes, times = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            row = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            order = np.argsort((codes // size_b % shards).astype(np.uint16), kind="stable")
            codes, times, row = codes[order], times[order], row[order]
            shard = codes // size_b % shards
            cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            found = np.zeros(len(codes), np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                known, n = mapped_pairs(folder, int(shard[a]))
                at = np.searchsorted(known, codes[a:b])
                if (known[np.minimum(at, len(known) - 1)] != codes[a:b]).any():
                    raise ValueError(f"a pair is not in shard {shard[a]}")
                found[a:b] = n[at]
            total, best = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
            np.add.at(total, row, np.abs(found) * times)
            np.add.at(best, row, (found < 0) * times)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(best), pa.array(total)], names=[*names, "n_best", "count_sum"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in names)
    return aligned.mapInArrow(run, f"{ddl}, n_best long, count_sum long")


def align(docs: DataFrame, a: str = DEFAULT, b: str = PIECES, groups: bool = False, block: int = BLOCK) -> DataFrame:
    """Per row: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best``, ``count_sum``; with ``groups`` their text as well."""
    both = Sides(a, b)
    sides = docs.sparkSession.sparkContext.broadcast(both)
    aligned = materialize(swept(events(docs, sides, block), sides, groups), "aligned")
    size_b = sentencepiece.SentencePieceProcessor(model_proto=both.b).vocab_size()
    return scored(aligned, count_pairs(aligned, size_b), size_b)
