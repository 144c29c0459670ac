"""Byte-level BPE vocabularies read from a tokenizers JSON file, and exact encoding of whole texts.

``Encoder`` gives the ids that the tokenizers library gives for the same file. Where the file is a plain byte-level
BPE whose ids follow its merges, texts of common characters go through tiktoken's merge loop over the same ranks
(several times faster); every other text goes through tokenizers itself. Both paths are compared in the tests.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"
#: Characters on which all regular-expression engines agree about letter, number and white space.
COMMON = re.compile("[\t\n\r -~¡-ſ‐-‧€]*")


@cache
def byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return table


def to_bytes(token: str) -> bytes:
    table = byte_of()
    return bytes(table[c] for c in token)


def load_json(name: str = DEFAULT) -> str:
    """The vocabulary file's content; ``name`` is a path or a file of public_tokenizers."""
    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Encodes texts to arrays of unsigned 32-bit ids. Built from the file's content, so only the driver needs the file.

    Without ``specials``, strings of special tokens inside texts are ordinary text.
    """

    def __init__(self, content: str, specials: bool = True):
        self.whole = Tokenizer.from_str(content)
        self.whole.encode_special_tokens = not specials
        self.whole.no_padding()
        self.whole.no_truncation()
        spec = json.loads(content)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        order = [ranks[to_bytes(a + b)] for a, b in merges]
        self.special = special if specials else {}
        self.fast = None
        if spec["normalizer"] is None and sorted(ranks.values()) == list(range(len(ranks))) and order == list(range(256, 256 + len(order))):
            self.fast = tiktoken.Encoding("from-json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is None or any(s in text for s in self.special) or not COMMON.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


_ready: dict[int, Encoder] = {}


def broadcast_vocabulary(spark: SparkSession, name: str = DEFAULT):
    """Ship the file's content (a few MB, bounded by the vocabulary) to the executors."""
    return spark.sparkContext.broadcast(load_json(name))


def worker_encoder(content: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = hash(content)
    if key not in _ready:
        _ready[key] = Encoder(content)
    return _ready[key]
