"""Best-fit packing by minimum bin slack: a bitset subset-sum finds the fullest combination of available lengths for each bin."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import forget, map_arrow, slices, staged, text_of

#: Pieces of text that a worker remembers the ids of; its memory is emptied when full.
MEMORY_ENTRIES = 300_000
_AWKWARD = re.compile(r" \s|\s ")
#: Texts of these characters alone: what kind each is (letter, digit, blank, other) has not changed over versions of Unicode.
_SETTLED = re.compile(r"[\n\x20-\x7e\u00c0-\u024f]*")
#: Runs of blanks too long for a regular expression that backtracks.
_WIDE = re.compile(r"[ \n]{4096}")


def same_merges(path: str):
    """A tiktoken encoding with the same ids as a tokenizers file, for texts of settled characters; None if that can't be shown.

    Both split at the byte-level pattern. Both then merge by rank, but tiktoken joins any two neighbours whose bytes are a
    token, while the file lists which pairs may. Two neighbours that make token t were made within t's own bytes, so they are
    the pair that stands in the file if merging t's bytes alone gives t; this is checked for every token.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as file:
        written = json.load(file)
    model, splits = written["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    before = written.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or not plain or written.get("normalizer") or any(before.get(k) != v for k, v in splits.items()):
        return None
    spelled = {b: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0] for b in range(128)}
    spelled = {c: bytes([b]) for b, c in spelled.items() if len(c) == 1}
    for first in range(0xC2, 0xF5):  # every byte beyond ASCII, from characters that hold it
        for last in range(0x80, 0xC0):
            raw = bytes([first, last]) if first < 0xE0 else bytes([first, 0xA0 if first == 0xE0 else 0x80, last]) if first < 0xF0 else bytes([first, 0x90 if first == 0xF0 else 0x80, 0x80, last])
            signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(raw.decode(errors="replace"))[0][0]
            if len(signs) == len(raw):
                spelled[signs[0]], spelled[signs[-1]] = raw[:1], raw[-1:]
    added = {t["content"] for t in written.get("added_tokens", ())}
    library, ranks = Tokenizer.from_file(path).model, {}
    for token, number in model["vocab"].items():
        if token in added:
            continue
        if any(c not in spelled for c in token):
            if len(token) > 1:
                return None
            continue  # a byte that no text holds
        if [t.id for t in library.tokenize(token)] != [number]:
            return None
        ranks[b"".join(map(spelled.__getitem__, token))] = number
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    for b in range(256):  # the library wants all bytes; these are in no text
        ranks.setdefault(bytes([b]), len(model["vocab"]) + b)
    return tiktoken.Encoding("same merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Ids of texts by a tokenizers file, as little-endian unsigned 32-bit integers.

    Texts of settled characters go to the faster library with the same merges, if there is one. For other texts: the byte-level pre-tokenizer starts a new pre-token at every space between two non-spaces, and merges never cross
    pre-tokens; so the library encodes each distinct piece between such spaces once, and texts are joined from these.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.memory: dict[str, bytes] = {}
        self.opens = None
        self.same = same_merges(path)

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, new: list[str]) -> list[bytes]:
        """Ids of pieces, each with a space before it, many in one call: a token that opens with a space opens a piece, and no other does."""
        import numpy as np

        if self.opens is None:
            size = self.library.get_vocab_size()
            self.opens = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        out: list[bytes] = []
        for at in range(0, len(new), 64):
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(new[at : at + 64])], add_special_tokens=False)[0].ids, "<u4")
            data, edges = ids.tobytes(), (np.flatnonzero(self.opens[ids]) * 4).tolist()
            out += [data[s:e] for s, e in zip(edges, [*edges[1:], len(data)], strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        quick = [self.same is not None and not self.special(t) and bool(_SETTLED.fullmatch(t)) and not (len(t) > 4096 and _WIDE.search(t)) for t in texts]
        others = iter(self.remembered([t for t, q in zip(texts, quick, strict=True) if not q]))
        return [np.array(self.same.encode_ordinary(t), "<u4").tobytes() if q else next(others) for t, q in zip(texts, quick, strict=True)]

    def special(self, text: str) -> bool:
        """Whether the library finds an added token (such as <|endoftext|>) written in the text: it becomes that token's id."""
        return any(map(text.__contains__, self.added))

    def remembered(self, texts: list[str]) -> list[bytes]:
        forget(self.memory, MEMORY_ENTRIES)
        cut = [None if not t or self.special(t) or t[0] == " " or t[-1] == " " or _AWKWARD.search(t) else t.split(" ") for t in texts]
        missing: set[str] = set()
        for pieces in cut:
            if pieces:
                missing.update(pieces[1:])
        missing.difference_update(self.memory)
        if missing:
            new = list(missing)
            self.memory.update(zip(new, self.pieces(new), strict=True))
        heads = self.whole([t if pieces is None else pieces[0] for t, pieces in zip(texts, cut, strict=True)])
        get = self.memory.__getitem__
        return [h + b"".join(map(get, pieces[1:])) if pieces else h for h, pieces in zip(heads, cut, strict=True)]


@cache
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_column: str, text_column: str, keep_ids: bool) -> DataFrame:
    """Token pieces of every text, with the writing task (_task) and the piece's number among the task's pieces of its length (_nth)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _nth bigint" + ", ids array<int>" * keep_ids
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen, tokens, last = TaskContext.get().partitionId(), Counter(), tokens_of(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in slices(batches):
            out: list[list] = [[] for _ in arrow]
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                ids += last
                total = len(ids) // 4
                n = -(-total // capacity)
                stop = total - capacity * (n - 1)
                start = 0
                for k in range(n):
                    part, length = ids[4 * start : 4 * stop], stop - start
                    row = (doc_id, k, start, length, zlib.crc32(part), task, seen[length]) + ((np.frombuffer(part, "<i4"),) if keep_ids else ())
                    seen[length] += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start, stop = stop, stop + capacity
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t.type) for v, t in zip(out, arrow, strict=True)], schema=arrow)

    return docs.select(id_column, text_of(text_column).alias("text")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of lengths that together come as near to room as any: bounded subset-sum on the bits of an integer.

    Lengths are tried from the longest, and each is used as often as the traced sum allows, so few long pieces are preferred.
    """
    full, mask = 1 << room, (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, share = min(counts[length], room // length), 1
        while left:
            share = min(share, left)
            steps.append((reach, length, share))
            reach |= reach << length * share & mask
            left -= share
            share *= 2
        if reach & full:
            break
    total, used = reach.bit_length() - 1, Counter()
    for before, length, share in reversed(steps):
        if not before >> total & 1:
            total -= length * share
            used[length] += share
    return sorted(used.items(), reverse=True)


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, combination) until every piece is placed. Each bin starts with the longest piece left; a combination
    repeats as often as the counts allow, so the work depends on the number of lengths, not of pieces."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        combination = Counter(dict(fullest({k: v for k, v in rest.items() if v}, capacity - seed)))
        combination[seed] += 1
        times = min(left[k] // m for k, m in combination.items())
        for k, m in combination.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        out.append((times, sorted(combination.items(), reverse=True)))
    return out


def segments(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces a bin, first bin, offset): where the pieces of a length go, by rank among them."""
    out, placed, bins = [], Counter(), 0
    for times, combination in minimum_slack(counts, capacity):
        offset = 0
        for length, m in combination:
            out.append((length, placed[length], m, bins, offset))
            placed[length] += times * m
            offset += length * m
        bins += times
    return sorted(out)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack every text's tokens, with end_id after them, into as few sequences of at most capacity tokens as it can.

    Ids are those of the tokenizers library with add_special_tokens=False, so an added token that a text spells out is
    that token's id. Returns id_column, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids), a row for each
    piece. Only texts of more than capacity tokens are cut; their first piece takes what full pieces leave. A null or
    empty text is one piece of end_id alone; null ids, repeated rows and extra columns do no harm, and an empty table
    gives no rows. Texts are read once, without a shuffle; the driver gets one count a length (capacity numbers at
    most) and returns one list of segments bounded by those; pieces find their rank among all of their length by a
    sum over tasks, so no length is gathered in one place.
    """
    made = staged(pieces(docs, tokenizer_path, capacity, end_id, id_column, text_column, keep_ids), "pieces")
    per_task = made.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    placed = segments(counts, capacity)
    before = per_task.select(
        F.col("length").alias("_length"), F.col("_task").alias("_of"), F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    ranked = made.join(before, (made["length"] == before["_length"]) & (made["_task"] == before["_of"])).select(*[c for c in made.columns if c[0] != "_"], (F.col("_nth") + F.col("_before")).alias("_rank"))
    at = ranked.columns.index("length")
    kept = [c for c in ranked.columns if c not in ("_rank", "ids")]
    fields = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in kept) + ", sequence_id bigint, offset bigint" + ", ids array<int>" * keep_ids

    def make():
        import numpy as np

        table = np.array(placed or [(0, 0, 1, 0, 0)], np.int64)
        wide = np.int64(1) << np.int64(48)
        starts = table[:, 0] * wide + table[:, 1]

        def step(batch):
            length, rank = (batch.column(i).to_numpy() for i in (at, len(kept)))
            s = table[np.searchsorted(starts, length * wide + rank, "right") - 1]
            k = rank - s[:, 1]
            return (*(batch.column(i) for i in range(len(kept))), s[:, 3] + k // s[:, 2], s[:, 4] + k % s[:, 2] * length, *((batch.column(len(kept) + 1),) if keep_ids else ()))

        return step

    return map_arrow(ranked.select(*kept, "_rank", *(["ids"] if keep_ids else [])), make, schema, 1)
