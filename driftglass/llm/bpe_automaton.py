"""BPE as a deterministic automaton over tokens, built merge by merge, with table-driven encoding and decoding.

The automaton starts as one state with a loop for every byte. Each merge (u, v) -> w applies the merge gadget: the
state p that u-arcs lead to is copied without its v-arc, all u-arcs are led to the copy, and every state that could
go u then v gets a w-arc to where v led from p. Since all arcs with one label lead to one state, there is at most one
new state per merge. The paths of the finished automaton are exactly the correct tokenizations.

A copy differs from its original in a single arc, so states are kept as a tree: ``removed[s]`` is the arc that s lost
when merge ``s`` copied its parent. Whether a state has an arc w follows from the tables: w is missing where an
ancestor lost w, or lost a left part of w before the merge that would have read it (``has_arc``; each answer is kept
in a transition table). Encoding a pre-split word walks tokens along such transitions, longest first, and marks byte
positions from which no path leads on, so each position is left at most once. Decoding emits the labels of the arcs.

Defined cases: null texts count as empty and encode to no ids; special tokens in a text become their ids; very long
texts are encoded piece by piece, very long words in linear time, as a step looks no further than the longest label; there
is one correct path for each word, so ties don't arise; repeated rows each get their row; an empty table gives none. A vocabulary of over
``MOST_IDS`` ids is refused, as pairs of ids share one number. Pieces (text between single blanks) of up
to ``LONG`` characters are kept in two tables per worker that rotate when one has ``KEEP`` entries, so memory stays
bounded. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from driftglass.llm.common import slices
from driftglass.llm.tokens import DEFAULT, load_json, to_bytes

KEEP = 250_000
MOST_IDS = 1 << 20
LONG = 64  # characters of a piece that is kept
BLANK = re.compile(r"(?<=\S) (?=\S)")
ODD_BLANK = re.compile(r"(?<!\S) | (?!\S)")


def compile_automaton(content: str) -> dict:
    """Run the merge gadgets in order of priority. Bounded by the vocabulary, so it runs on the driver."""
    spec = json.loads(content)
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        if token not in special:
            labels[i] = to_bytes(token)
    for token, i in special.items():
        labels[i] = token.encode()
    if len(labels) > MOST_IDS:
        raise ValueError(f"a vocabulary of {len(labels)} ids; {MOST_IDS} are the most")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    size = len(labels)
    state_of = [0] * size  # where arcs with this label lead; state 0 is the start
    parent, removed = [-1], [-1]
    left, born = [-1] * size, [0] * size
    for stamp, (a, b) in enumerate(merges, 1):
        u, v, w = vocab[a], vocab[b], vocab[a + b]
        before = state_of[v]
        parent.append(state_of[u])
        removed.append(v)
        state_of[u] = stamp
        state_of[w], left[w], born[w] = before, u, stamp
    children: list[list[int]] = [[] for _ in parent]
    for s in range(1, len(parent)):
        children[parent[s]].append(s)
    first, last, clock = [0] * len(parent), [0] * len(parent), 0
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            last[s] = clock
            continue
        clock += 1
        first[s] = clock
        stack.append((s, True))
        stack += [(c, False) for c in children[s]]
    losses: dict[int, list[tuple[int, int, int]]] = {}
    for s in range(1, len(parent)):
        losses.setdefault(removed[s], []).append((first[s], last[s], s))
    for x in losses.values():
        x.sort()
    return {
        "labels": labels, "special": special, "left": left, "born": born,
        "at": [first[s] for s in state_of],
        "losses": {k: ([x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for k, v in losses.items()},
    }


class Automaton:
    """The compiled tables in one worker."""

    def __init__(self, tables: dict):
        self.labels, self.special = tables["labels"], tables["special"]
        self.left, self.born, self.at, self.losses = tables["left"], tables["born"], tables["at"], tables["losses"]
        plain = {i for i in range(len(self.labels))} - set(self.special.values())
        self.ids = {self.labels[i]: i for i in plain}
        self.longest = max(map(len, self.ids))
        self.step: list[dict[int, int]] = [{}]  # a trie of the labels: byte to node
        self.token = [-1]
        for label, i in self.ids.items():
            node = 0
            for b in label:
                if b not in self.step[node]:
                    self.step[node][b] = len(self.step)
                    self.step.append({})
                    self.token.append(-1)
                node = self.step[node][b]
            self.token[node] = i
        self.arcs: dict[int, bool] = {}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def has_arc(self, u: int, w: int) -> bool:
        """Whether token w may follow token u."""
        here, x, bound = self.at[u], w, 1 << 60
        while x >= 0:
            if (lost := self.losses.get(x)) is not None:
                i = bisect_right(lost[0], here) - 1
                if i >= 0 and here <= lost[1][i] and lost[2][i] <= bound:
                    return False
            bound, x = self.born[x], self.left[x]
        return True

    def word(self, data: bytes) -> list[int]:
        """The one path whose labels spell ``data``."""
        if (whole := self.ids.get(data)) is not None:
            return [whole]
        step, token, labels, arcs = self.step, self.token, self.labels, self.arcs
        n, at, u, most, longest = len(data), 0, -1, len(data), self.longest
        path: list[int] = []
        dead: set[int] = set()
        while at < n:
            node, able = 0, []
            for b in data[at : min(most, at + longest)]:
                node = step[node].get(b)
                if node is None:
                    break
                if (w := token[node]) >= 0:
                    able.append(w)
            for w in reversed(able):
                if dead and at + len(labels[w]) in dead:
                    continue
                if u >= 0:
                    key = u << 20 | w
                    ok = arcs.get(key)
                    if ok is None:
                        ok = arcs[key] = self.has_arc(u, w)
                    if not ok:
                        continue
                path.append(w)
                at += len(labels[w])
                u, most = w, n
                break
            else:
                if not path:
                    raise ValueError("no path spells this word")
                dead.add(at)
                most = at - 1
                at -= len(labels[path.pop()])
                u = path[-1] if path else -1
        return path

    def piece(self, text: str) -> bytes:
        return array("I", [i for x in self.split(text) for i in self.word(x.encode())]).tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. A single blank between other characters always starts a word."""
        pieces = text.split(" ") if ODD_BLANK.search(text) is None else BLANK.split(text)
        kept, older = self.kept, self.older
        out = [self.piece(pieces[0])]
        for x in pieces[1:]:
            ids = kept.get(x)
            if ids is None:
                ids = older.get(x)
                if ids is None:
                    ids = self.piece(" " + x)
                if len(x) <= LONG:
                    kept[x] = ids
            out.append(ids)
        if len(kept) > KEEP:
            self.kept, self.older = {}, kept
        if len(self.arcs) > 4 * KEEP:
            self.arcs.clear()
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.apart is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.apart.split(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if i % 2 else self.plain(x) if x else b"" for i, x in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ready: dict[int, Automaton] = {}


def worker_automaton(number: int, tables: dict) -> Automaton:
    if number not in _ready:
        _ready.clear()
        _ready[number] = Automaton(tables)
    return _ready[number]


def encode_decode(docs: DataFrame, vocabulary: str = DEFAULT) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``, the ids' text."""
    tables = docs.sparkSession.sparkContext.broadcast(compile_automaton(load_json(vocabulary)))
    number = tables._jbroadcast.id()

    def run(batches):
        bpe = worker_automaton(number, tables.value)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            ids = [bpe.encode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()), "decoded": pa.array([bpe.decode(x) for x in ids], pa.string()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
