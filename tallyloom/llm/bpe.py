"""Byte-level BPE with a two-tier lookup: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import forget, map_arrow, text_of

#: Entries that a worker's memory of already encoded pieces may hold; it is emptied when full, which costs time only.
MEMORY_ENTRIES = 300_000
#: White space next to a space: only then a space may not start a pre-token.
_AWKWARD = re.compile(r" \s|\s ")


class MinimalPerfectHash:
    """Hash and displace: n keys fill n slots, and a lookup computes one hash, reads one displacement and compares one key."""

    def __init__(self, keys: list[bytes], values: list[int]):
        from xxhash import xxh3_64_intdigest as digest

        self.digest, self.n = digest, max(1, len(keys))
        self.buckets = max(1, self.n // 4)
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [0] * self.n
        self.displace = [0] * self.buckets
        grouped: dict[int, list[int]] = {}
        hashes = [digest(k) for k in keys]
        for i, h in enumerate(hashes):
            grouped.setdefault(h % self.buckets, []).append(i)
        taken = bytearray(self.n)
        free = iter(range(self.n))
        for bucket in sorted(grouped, key=lambda b: -len(grouped[b])):
            members = grouped[bucket]
            if len(members) == 1:  # the last buckets take what is left: no search needed
                slot = next(s for s in free if not taken[s])
                self.displace[bucket] = -slot - 1
                slots = [slot]
            else:
                d = 1
                while len(set(slots := [self._slot(hashes[i], d) for i in members])) < len(members) or any(taken[s] for s in slots):
                    d += 1
                self.displace[bucket] = d
            for i, slot in zip(members, slots, strict=True):
                taken[slot], self.keys[slot], self.values[slot] = 1, keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 31)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def get(self, key: bytes) -> int | None:
        h = self.digest(key)
        d = self.displace[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else None


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers, decode(those) the text's bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(k): int(v) for k, v in (x.split() for x in lines if x.strip())}
        self.whole = MinimalPerfectHash(list(self.ranks), list(self.ranks.values()))
        self.words = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.memory = _Memory(self)

    def heap(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until no neighbours are in the vocabulary."""
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, j, stop = heapq.heappop(queue)
            if end[i] != j or j >= n or end[j] != stop:
                continue  # one side has been merged since
            k = after[j]
            end[i], after[i], end[j] = stop, k, -1
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(queue, (r, i, k, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(queue, (r, h, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def pretoken(self, token: str) -> list[int]:
        piece = token.encode()
        known = self.whole.get(piece)
        return [known] if known is not None else self.heap(piece)

    def plain(self, text: str) -> bytes:
        ids = [i for token in self.split(text) for i in self.pretoken(token)]
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, text: str) -> bytes:
        """A space between two other non-spaces always starts a pre-token, so a text is cut there and pieces are remembered."""
        if not text:
            return b""
        forget(self.memory, MEMORY_ENTRIES)
        if _AWKWARD.search(text) or text[0] == " " or text[-1] == " ":
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.memory.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memory(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        self[piece] = out = self.encoder.plain(" " + piece)
        return out


@cache
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """Ids of every text, and the text that they decode to.

    Returns id_column, n_tokens, and ids (array of int) with decoded (string), or for digests ids_sha256 and
    decoded_sha256, which spares moving the ids. One row per input row, in one pass without a shuffle. A null text
    counts as empty (no ids); null ids, repeated rows and extra columns pass through or are ignored. No special
    tokens: their strings in a text are ordinary text. Memory: one Arrow slice and MEMORY_ENTRIES remembered pieces.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {id_type}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def make():
        import numpy as np

        own = encoder(ranks_path, pattern)

        def step(batch):
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            n = [len(x) // 4 for x in ids]
            if digests:
                a, b = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
            else:
                a, b = [np.frombuffer(x, "<i4") for x in ids], [own.decode(x).decode() for x in ids]
            return batch.column(0), n, a, b

        return step

    return map_arrow(docs.select(F.col(id_column), text_of(text_column).alias("text")), make, schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The text of every row of ids (array of int); null ids decode to the empty text, bytes that are no UTF-8 to U+FFFD."""
    id_type = tokens.schema[id_column].dataType.simpleString()

    def make():
        words = encoder(ranks_path, pattern).words

        def step(batch):
            return batch.column(0), [b"".join([words[i] for i in x or ()]).decode(errors="replace") for x in batch.column(1).to_pylist()]

        return step

    return map_arrow(tokens.select(id_column, ids_column), make, f"{id_column} {id_type}, text string")
