"""Language-model scoring: a weighted backoff automaton over word n-grams, counted over all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SLICE_BYTES, staged, text_of

#: Longest n-gram.
ORDER = 3
#: Added to every count of the single-token distribution.
ADDED = 0.1
#: Weight of the lower order: a context seen c times trusts its own followers by c / (c + TRUST).
TRUST = 4.0
#: A context is a state of the automaton if it was seen so often; one seen once knows one text, often the very one that is scored.
LEAST_CONTEXT = 2
END, START = 0, 1  # symbols that no word has
#: Bytes of text from which a block is closed: what a task holds at once (a longer text cannot be cut).
BLOCK_BYTES = 5 << 20
#: Bits of a hash that are sent of n-grams of two words and more (single words: all 64). Their sorted differences are what the shuffle carries.
SENT_BITS = 56
#: Sums over all documents; a block's own counts fit 32 bits, as Arrow holds less than 2 ** 31 bytes of a text.
SUMS = "<u8"
#: Senders that meet in one node of the tree of sums, and the ranges of hashes into which a sender cuts its n-grams.
FAN_BITS = 8
#: Tokens of a lane: longer texts are walked by several lanes at once.
LANE = 256


class BackoffAutomaton:
    """States are contexts; a state has arcs for the symbols seen after it and one failure arc to its longest suffix that is a state.

    root, after_root: log10 probability of every symbol in the empty context (state 0), and the state it leads to.
    fail, back: log10 weight and target of every state's failure arc. keys, weights, after: arcs, sorted by
    state * symbols + symbol, with their log10 probabilities and targets. start: the state of a text's beginning.
    """

    def __init__(self, root, after_root, fail, back, keys, weights, after, start):
        self.root, self.after_root, self.fail, self.back = root, after_root, fail, back
        self.keys, self.weights, self.after, self.start = keys, weights, after, start

    def step(self, state, symbols):
        """log10 probabilities of one symbol after each state, and the states that follow: failure arcs until an arc takes the symbol."""
        import numpy as np

        p, follows = np.zeros(len(state)), np.zeros(len(state), np.int64)
        live, at = np.arange(len(state)), state
        while live.size:
            s = symbols[live]
            empty = at == 0
            done = live[empty]
            p[done] += self.root[s[empty]]
            follows[done] = self.after_root[s[empty]]
            live, at, s = live[~empty], at[~empty], s[~empty]
            if not live.size:
                break
            key = at * len(self.root) + s
            arc = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(key), bool)
            p[live[hit]] += self.weights[arc[hit]]
            follows[live[hit]] = self.after[arc[hit]]
            live, at = live[~hit], at[~hit]
            p[live] += self.fail[at]
            at = self.back[at]
        return p, follows

    def walk(self, symbols, starts, order: int, lane: int = LANE):
        """log10 probabilities of symbols, each text read from left to right from the state of its START (at starts).

        Lanes are read side by side and carry their state. A text of more than `lane` symbols is cut; a further lane starts
        order - 1 symbols early in the empty context, as these decide the state and nothing before them does.
        """
        import numpy as np

        ends = np.append(starts[1:], len(symbols))
        lanes = -(-(ends - starts - 1) // lane)
        text = np.repeat(np.arange(len(starts)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        warm = np.where(nth > 0, np.minimum(order - 1, lane), 0)
        begin = starts[text] + 1 + nth * lane - warm
        size = np.minimum(starts[text] + 1 + (nth + 1) * lane, ends[text]) - begin
        by_size = np.argsort(-size, kind="stable")
        begin, size, warm = begin[by_size], size[by_size], warm[by_size]
        state = np.where(nth[by_size] > 0, 0, self.start)
        out = np.zeros(len(symbols))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))
            at = begin[:n] + t
            p, state = self.step(state[:n], symbols[at])
            heard = t >= warm[:n]
            out[at[heard]] = p[heard]
        return out


def hashed(words: list[bytes]):
    """64-bit hashes of words; the first two symbols are the end and the start of a text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest as digest

    return np.array([digest(b"\n" + bytes([i])) for i in (END, START)] + [digest(w) for w in words], np.uint64)


def pair_hash(a, b):
    import numpy as np

    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (b ^ (b >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) & np.uint64((1 << 64) - (1 << (64 - SENT_BITS)))


class Grams:
    """The distinct n-grams of one length in a block: ids (of the n-gram that ends at each position, or -1), and of each
    n-gram its hash, the n-grams without the last and without the first symbol, the last symbol."""

    def __init__(self, ids, hashes, context=None, suffix=None, last=None):
        self.ids, self.hashes, self.context, self.suffix, self.last = ids, hashes, context, suffix, last


class Block:
    """The tokens of some documents: symbols with a START before each text, where texts start, their lengths in tokens, n-grams by length."""

    def __init__(self, texts, order: int):
        import numpy as np

        numbers: dict[bytes, int] = {}
        parts, lengths, size = [], [], 0
        held: list[bytes] = []

        def take():
            flat: list[int] = []
            for t in held:
                words = t.lower().split()
                lengths.append(len(words) + 1)
                flat.append(START)
                flat += [n if (n := get(w)) is not None else add(w, len(numbers) + 2) for w in words]
                flat.append(END)
            parts.append(np.array(flat, np.int32))
            held.clear()

        get, add = numbers.get, numbers.setdefault
        for t in texts:
            held.append(t.encode())
            size += len(held[-1])
            if size > SLICE_BYTES // 4:
                take()
                size = 0
        take()
        self.symbols, self.lengths = np.concatenate(parts), np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        words = hashed(list(numbers))
        self.grams = [Grams(self.symbols, words)]
        for n in range(2, order + 1):
            lower = self.grams[-1]
            ends = np.ones(len(self.symbols), bool)
            ends[self.starts] = False
            if n > 2:
                ends[1:] &= lower.ids[:-1] >= 0
            ends = np.flatnonzero(ends)
            codes = lower.ids[ends - 1].astype(np.int64) * len(words) + self.symbols[ends]
            order_of = np.argsort(codes).astype(np.int32)
            codes = codes[order_of]
            new = np.ones(len(codes), bool)
            new[1:] = codes[1:] != codes[:-1]
            ids = np.full(len(self.symbols), -1, np.int32)
            ids[ends[order_of]] = np.cumsum(new, dtype=np.int32) - 1
            at, codes = ends[order_of[new]].astype(np.int32), codes[new]
            context, last = (codes // len(words)).astype(np.int32), (codes % len(words)).astype(np.int32)
            del codes, order_of, new, ends
            self.grams.append(Grams(ids, pair_hash(lower.hashes[context], words[last]), context, lower.ids[at] if n > 2 else last, last))

    def counts(self, train) -> list:
        """Of each length, how often every n-gram occurs in the texts where train is true."""
        import numpy as np

        learned = np.repeat(train, self.lengths + 1)
        return [np.bincount(g.ids[learned & (g.ids >= 0)], minlength=len(g.hashes)) for g in self.grams]

    def arcs(self, length: int, shorter, least_context: int):
        """The n-grams of a length whose context is a state by the sums of the shorter ones: no other can be an arc, or a state itself."""
        import numpy as np

        return np.flatnonzero(shorter[self.grams[length - 1].context] >= least_context)

    def automaton(self, sums: list, tokens: int, distinct: int, added: float, trust: float, least_context: int):
        """The part of the automaton that the block's texts can reach, from the sums over all documents, and those of single tokens."""
        import numpy as np

        size, order = len(sums[0]), len(self.grams)
        single = sums[0].copy()
        single[START] = 0  # how often the starting context occurs; not a token
        probability = [(single + added) / (tokens + added * (distinct + 1))]
        is_state = [s >= least_context for s in sums[:-1]] if order > 1 else []
        first, states = [], 1
        for s in is_state:
            first.append(states)
            states += len(s)
        own = [np.where(s, f + np.arange(len(s)), 0) for s, f in zip(is_state, first, strict=True)]
        reached = [own[0] if order > 1 else np.zeros(size, np.int64)]  # the longest suffix of each n-gram that is a state
        fail, back = [np.zeros(1)], [np.zeros(1, np.int64)]
        keys, weights, after = [], [], []
        for n, g in enumerate(self.grams):
            if n:
                target = reached[n - 1][g.suffix]
                reached.append(np.where(own[n] > 0, own[n], target) if n < order - 1 else target)
                contexts = sums[n - 1][g.context]
                probability.append((sums[n] + trust * probability[n - 1][g.suffix]) / (contexts + trust))
                arc = np.flatnonzero((sums[n] > 0) & is_state[n - 1][g.context])
                keys.append((first[n - 1] + g.context[arc].astype(np.int64)) * size + g.last[arc])
                weights.append(np.log10(probability[n][arc]))
                after.append(reached[n][arc])
            if n < order - 1:
                fail.append(np.log10(trust / (sums[n] + trust)))
                back.append(reached[n - 1][g.suffix] if n else np.zeros(size, np.int64))
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        keys, weights, after = join(keys, np.int64), join(weights, float), join(after, np.int64)
        by_key = np.argsort(keys)
        return BackoffAutomaton(np.log10(probability[0]), reached[0], np.concatenate(fail), np.concatenate(back), keys[by_key], weights[by_key], after[by_key], int(reached[0][START])), single


def pack(values) -> bytes:
    """Bytes in planes, the differences of sorted keys first, so that the shuffle's compression finds the zeros."""
    return values.view("u1").reshape(-1, values.itemsize).T.tobytes() if len(values) else b""


def unpack(data: bytes, kind: str):
    import numpy as np

    width = np.dtype(kind).itemsize
    return np.frombuffer(data, "u1").reshape(width, -1).T.copy().view(kind).ravel() if data else np.empty(0, kind)


def _ranges(keys, values, shift: int):
    """(bucket, packed differences of keys, packed values) of each range of sorted keys; a bucket is a key's bits from shift on."""
    import numpy as np

    buckets = keys >> np.uint64(shift) if shift < 64 else np.zeros(len(keys), np.uint64)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if start < stop:
            yield int(buckets[start]), pack(np.diff(keys[start:stop], prepend=np.uint64(0)).astype("<u8")), pack(values[start:stop])


def _merged(table):
    """The distinct keys of some senders' rows, which of them every sender's keys are, the sums, and how many keys each row has."""
    import numpy as np

    keys = [np.cumsum(unpack(k, "<u8"), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    values = np.concatenate([unpack(c, SUMS) for c in table.column("counts").to_pylist()]).astype(np.int64)
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, which, values)
    return distinct, which, sums, [len(k) for k in keys]


_SENT = "sender bigint, kind int, bucket bigint, keys binary, counts binary"
_BACK = "sender bigint, kind int, bucket bigint, sums binary, tokens bigint, distinct_tokens bigint"


def _replies(table, which, sums, sizes, totals):
    import numpy as np
    import pyarrow as pa

    back, ends, n = sums[which].astype(SUMS), np.cumsum(sizes), len(sizes)
    parts = [pack(back[e - s : e]) for s, e in zip(sizes, ends.tolist(), strict=True)]
    return pa.Table.from_arrays(
        [*(table.column(c).combine_chunks() for c in ("sender", "kind", "bucket")), pa.array(parts, pa.binary()), *(pa.array([x] + [0] * (n - 1), pa.int64()) for x in totals)],
        ["sender", "kind", "bucket", "sums", "tokens", "distinct_tokens"],
    )


def exchanged(sent: DataFrame, senders: int, bits: int, shift: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """Each sender's counts summed over all senders, in the order it sent them (_SENT to _BACK).

    A tree: while there are more senders than a node takes, nodes of some senders merge a range's rows, cut the range
    again and send as one; the sums come back by the same way. A node holds about as many keys as one block, and
    the number of rows is that of senders times ranges at every level, so both follow the input.
    """
    import pyarrow as pa

    fan = 1 << fan_bits
    if senders <= fan or shift <= 0:

        def total(table):
            distinct, which, sums, sizes = _merged(table)
            known = 0, 0
            if table.column("kind")[0].as_py() == 1:
                own = sums[distinct != hashed([])[START]]
                known = int(own.sum()), int((own > 0).sum())
            return _replies(table, which, sums, sizes, known)

        return sent.groupBy("kind", "bucket").applyInArrow(total, _BACK)

    nodes = -(-senders // max(2, fan // 2))
    lower = max(0, shift - bits)
    dealt = staged(sent.withColumn("node", F.pmod(F.xxhash64("sender"), F.lit(nodes)).cast("bigint")), "sent")

    def merge(table):
        distinct, _, sums, _ = _merged(table)
        rows = list(_ranges(distinct, sums.astype(SUMS), lower))
        n, kind = len(rows), table.column("kind")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array([table.column("node")[0].as_py()] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([r[0] - (1 << 64) * (r[0] >> 63) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            ["sender", "kind", "bucket", "keys", "counts"],
        )

    further = exchanged(dealt.groupBy("kind", "bucket", "node").applyInArrow(merge, _SENT), nodes, bits, lower, fan_bits)
    unsigned = F.col("bucket") if lower + bits > shift else F.shiftrightunsigned("bucket", shift - lower)
    further = further.withColumns({"of": F.col("bucket"), "bucket": unsigned, "node": F.col("sender")}).drop("sender")

    def back(table, found):
        import numpy as np

        _, which, _, sizes = _merged(table)
        order = np.argsort(found.column("of").to_numpy().view(np.uint64), kind="stable")
        parts = found.column("sums").to_pylist()
        sums = np.concatenate([unpack(parts[i], SUMS) for i in order.tolist()]).astype(np.int64)
        return _replies(table, which, sums, sizes, (sum(found.column("tokens").to_pylist()), sum(found.column("distinct_tokens").to_pylist())))

    return dealt.groupBy("kind", "bucket", "node").cogroup(further.groupBy("kind", "bucket", "node")).applyInArrow(back, _BACK)


def blocked(docs: DataFrame, train: Column, id_column: str, text_column: str) -> DataFrame:
    """Documents in blocks of about BLOCK_BYTES of text, as they lie: block, data (id, train and text, compressed). Written, so that blocks stay as they are."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from tallyloom.llm.common import slices

        def close():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for x in held:
                    stream.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in x.columns], schema=x.schema))
            return pa.RecordBatch.from_arrays([pa.array([task << 33 | nth], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

        task, nth, held, size = TaskContext.get().partitionId(), 0, [], 0
        for piece in slices(batches, 2):
            ends, start = np.cumsum(pc.binary_length(piece.column(2)).to_numpy()), 0
            while start < piece.num_rows:  # up to and with the text that fills the block
                filled = ends[start - 1] if start else 0
                stop = min(piece.num_rows, int(np.searchsorted(ends, filled + BLOCK_BYTES - size)) + 1)
                held.append(piece.slice(start, stop - start))
                size, start = size + int(ends[stop - 1] - filled), stop
                if size >= BLOCK_BYTES:
                    yield close()
                    nth, held, size = nth + 1, [], 0
        if held:
            yield close()

    chosen = docs.select(F.col(id_column).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), text_of(text_column).alias("text"))
    return staged(chosen.mapInArrow(run, "block bigint, data binary"), "blocks")


def _by_block(sums: DataFrame):
    return sums.select(F.col("sender").alias("block"), "kind", "bucket", "sums").groupBy("block")


def _received(block: Block, found, longest: int, least_context: int) -> list:
    """The sums of a block's n-grams up to a length, from the rows that came back; those that were not sent have 0."""
    import numpy as np

    kinds, buckets, data = (found.column(c).to_pylist() for c in ("kind", "bucket", "sums"))
    out = []
    for kind, g in enumerate(block.grams[:longest], 1):
        sent = np.arange(len(g.hashes)) if kind < 3 else block.arcs(kind, out[-1], least_context)
        parts = [unpack(d, SUMS) for _, d in sorted((b, d) for k, b, d in zip(kinds, buckets, data, strict=True) if k == kind)]
        counts = np.zeros(len(g.hashes), np.int64)
        counts[sent[np.argsort(g.hashes[sent])]] = np.concatenate([*parts, np.empty(0, SUMS)])
        out.append(counts)
    return out


def _opened(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all()


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, added: float = ADDED, trust: float = TRUST, least_context: int = LEAST_CONTEXT, fan_bits: int = FAN_BITS) -> DataFrame:
    """log10 probabilities of every text under a model learned from the rows where train is true (null: false).

    Returns id_column, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row. Tokens are
    the words (runs of other than ASCII white space, A-Z lower-cased) and an end; a null or empty text has the end
    alone. base_score: single tokens with added counts. score: n-grams up to order, each order a Dirichlet prior of weight
    trust for the next; contexts seen less than least_context times have no followers of their own. As an automaton: an
    n-gram seen in training is an arc of its context, any other symbol takes failure arcs from context to shorter context
    until one has it. Words are told apart by 64-bit hashes, longer n-grams by SENT_BITS of theirs. Ids of any type and null ids pass through, other columns
    are ignored; repeated rows are scored alike and each counts; without training rows every count is 0; an empty
    table gives no rows. Very long texts are read whole (a block then has more than BLOCK_BYTES).

    Documents stay in blocks as they lie. Each block sends the sorted hashes of its distinct words and pairs with its own
    counts, then length by length those longer n-grams whose context has turned out to be a state, cut into ranges; ranges are summed over blocks in a tree, and every block gets its own n-grams' sums back and builds
    from them the part of the automaton that its texts reach. No table of all n-grams meets in one place.
    """
    blocks = blocked(docs, train, id_column, text_column)
    n = max(1, blocks.count())
    bits = min(fan_bits, max(4, (n - 1).bit_length()))
    columns = ["sender", "kind", "bucket", "keys", "counts"]

    def rows_of(name, kind, hashes, counts):
        import numpy as np
        import pyarrow as pa

        by_hash = np.argsort(hashes)
        rows = [(name, kind, *r) for r in _ranges(hashes[by_hash], counts[by_hash].astype(SUMS), 64 - bits)]
        return [pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)]

    def one(name, data):
        import numpy as np
        import pyarrow as pa

        table = _opened(data)
        block = Block(table.column("text").to_pylist(), min(order, 2))
        train = np.array(table.column("train").to_pylist(), bool)
        del table
        for kind, (g, c) in enumerate(zip(block.grams, block.counts(train), strict=True), 1):
            g.ids = None
            yield pa.RecordBatch.from_arrays(rows_of(name, kind, g.hashes, c), columns)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from one(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())

    def sender_of(length):
        def further(table, found):
            import numpy as np
            import pyarrow as pa

            name, table = table.column("block")[0].as_py(), _opened(table.column("data")[0].as_py())
            block = Block(table.column("text").to_pylist(), length)
            train = np.array(table.column("train").to_pylist(), bool)
            del table
            arcs = block.arcs(length, _received(block, found, length - 1, least_context)[-1], least_context)
            return pa.Table.from_arrays(rows_of(name, length, block.grams[-1].hashes[arcs], block.counts(train)[-1][arcs]), columns)

        return further

    sums = staged(exchanged(blocks.mapInArrow(send, _SENT), n, bits, 64 - bits, fan_bits), "ngrams")
    for length in range(3, order + 1):
        sent = blocks.groupBy("block").cogroup(_by_block(sums)).applyInArrow(sender_of(length), _SENT)
        sums = sums.unionByName(staged(exchanged(sent, n, bits, 64 - bits, fan_bits), "ngrams"))
    totals = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct_tokens"), F.lit(0))).first()
    tokens, distinct = int(totals[0]), int(totals[1])
    id_type = docs.schema[id_column].dataType.simpleString()

    def finish(table, found):
        import numpy as np
        import pyarrow as pa

        table = _opened(table.column("data")[0].as_py())
        ids, train = table.column("id").combine_chunks(), table.column("train").to_pylist()
        block = Block(table.column("text").to_pylist(), order)
        del table
        got = _received(block, found, order, least_context)
        for g in block.grams:
            g.ids = g.hashes = None
        automaton, single = block.automaton(got, tokens, distinct, added, trust, least_context)
        known, base = (single > 0).astype(np.int64)[block.symbols], automaton.root[block.symbols]
        base[block.starts] = 0
        each = automaton.walk(block.symbols, block.starts, order)
        total = lambda x: np.add.reduceat(x, block.starts)
        return pa.Table.from_arrays(
            [ids, pa.array([not x for x in train]), pa.array(block.lengths), pa.array(total(known)), pa.array(np.full(len(block.lengths), tokens)), pa.array(total(base)), pa.array(total(each))],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(_by_block(sums)).applyInArrow(finish, schema).withColumnRenamed("id", id_column)


def perplexity(scored: DataFrame) -> DataFrame:
    """10 ** (-score / n_tokens) beside the columns of score()."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
