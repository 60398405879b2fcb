"""LM scoring by context-tree weighting over bytes.

A text is its UTF-8 bytes, lower-cased in ASCII, and one end symbol (255, which no
UTF-8 text holds; it is also what stands before the first byte).  A byte is coded
as eight binary decisions.  Every decision - a prefix of the byte's bits - has a
context tree of its own over the ``depth`` bytes before; each node counts zeros and
ones, and the Krichevsky-Trofimov estimate gives their probability.  A node's
weighted probability is half its own estimate plus half the product of its
children's, so that all prunings of the tree, all depths, are mixed.

Blocks: each task joins its rows to blocks of about ``BLOCK`` bytes, without a shuffle, which
are stored compressed.  A block's distinct (depth + 1)-byte strings and its words are counted in
one task.  Strings are dealt to parts by the two bytes before the coded one, words by a hash; a block
sends each part one row (sorted, as compressed differences).

Parts: all deeper nodes of a string are in its part, so the tree above depth 2 is built there in
arrays, from the leaves up; what the parts have for the depths 0 and 1 (at most 256 * 255 nodes,
whatever the corpus) is summed up and mixed on the driver and goes back to all parts.  For a fixed
tree the mixture over a path of contexts is a weighted sum of the nodes' estimates, computed from
the root to the leaves.  Where a path leaves the tree - a context never seen - its deepest seen
node speaks.  A part answers each block with the log-probabilities of the strings it
sent, in their order (in single precision; they are added up in double), and with its words' counts.

Scoring: each block meets the answers of all parts (never the whole model) and adds them up along
its texts.  Strings and words are shuffled once each way, texts once.  The number of parts grows with the texts (one per
``PART_BYTES``, at most ``PARTS``).  Nothing that grows with the texts is broadcast or collected.

Defined cases: a null text is an empty one, and an empty text has the end symbol
only; rows that repeat an id are scored each; without training rows every decision
has probability 1/2.  A text is taken whole; the largest task holds a block, or one
text if that is larger, or a part's strings.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.llm.common import schema_of, small_batches, stored

DEPTH = 6  # bytes, about a word and the border before it; strings of 7 bytes fit a long
BLOCK = 16 << 20
PART = 2 << 20
PART_BYTES = 16 << 20
PARTS = 1 << 14
END = b"\xff"
NODES = 1 << 16  # of depth 1: the byte before, and the bits so far with a one in front

BLOCKS = "block long, learned long, size long, rows binary"
COUNTS = "part int, block long, grams binary, counts binary, words binary, word_counts binary"
SUBTREES = "part int, sent binary, zeros binary, ones binary, below binary"
ANSWERS = "block long, part int, tokens long, kinds long, scores binary, word_counts binary"
SCORES = "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base double, score double, n_bytes long"


def parts_of(texts: list[bytes], size: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    start, total = 0, 0
    for k, text in enumerate(texts):
        total += len(text) + 1
        if total >= size:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def keys_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings, first position per text): a string for every byte of every text and its end."""
    data = np.frombuffer(END * 7 + b"".join(t + END for t in texts), np.uint8)
    # eight bytes that end at each byte, as one number, the last byte lowest
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8))
    key = eights.view(">u8").reshape(-1).astype(np.int64) & ((1 << (8 * (depth + 1))) - 1)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # the bytes before a text are end symbols, whatever the text before it
    k = np.arange(depth - 1)
    inside = k < sizes[:, None]
    low = np.broadcast_to((1 << (8 * (k + 1))) - 1, inside.shape)[inside]
    at = (starts[:, None] + k)[inside]
    key[at] = (key[at] & low) | (((1 << (8 * (depth + 1))) - 1) & ~low)
    return key, starts


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, distinct strings in order, first position per text)."""
    key, starts = keys_of(texts, depth)
    distinct, codes = np.unique(key, return_inverse=True)
    return codes, distinct, starts


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes in front, then all second ones, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def ln_gammas(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ln Gamma(k + 1/2) and ln Gamma(k + 1) for k below n."""
    k = np.arange(1, n)
    half = np.concatenate([[0.0], np.cumsum(np.log(k - 0.5))]) + 0.5 * math.log(math.pi)
    return half, np.concatenate([[0.0], np.cumsum(np.log(k))])


def stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


class Estimate:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""

    def __init__(self, size: int = 1 << 12):
        self.size, (self.half, self.whole) = size, ln_gammas(size)

    def looked_up(self, table: np.ndarray, k: np.ndarray, plus: float) -> np.ndarray:
        out = table[np.minimum(k, self.size - 1)]
        large = np.flatnonzero(k >= self.size)
        if len(large):
            out[large] = stirling(k[large] + plus)
        return out

    def __call__(self, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        both = self.looked_up(self.half, zeros, 0.5) + self.looked_up(self.half, ones, 0.5)
        return both - self.looked_up(self.whole, zeros + ones, 1.0) - math.log(math.pi)


def mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of a node's weighted probability, and the odds of its own estimate against its children."""
    stay = 1 / (1 + np.exp(np.minimum(below - own, 700.0)))
    return np.logaddexp(own, below) - math.log(2), stay


def part_of(grams_: np.ndarray, parts: int) -> np.ndarray:
    """The part of each string: by the two bytes before the coded one."""
    return ((grams_ >> 8 & 0xFFFF) * 40503 >> 3) % parts


def turned(grams_: np.ndarray, depth: int) -> np.ndarray:
    """Strings with the nearest context byte first and the coded byte last."""
    out = grams_ & 255
    for d in range(1, depth + 1):
        out |= (grams_ >> (8 * d) & 255) << (8 * (depth + 1 - d))
    return out


class Subtree:
    """The nodes below depth 1 over strings in order (``turned``, distinct) with their counts, a decision's bit after the other."""

    def __init__(self, strings: np.ndarray, n: np.ndarray, depth: int):
        self.depth, self.estimate = depth, Estimate()
        self.keys, self.n, self.up = {depth: strings}, {depth: n}, {}
        for d in range(depth - 1, 1, -1):
            shorter = self.keys[d + 1] >> 16 << 8 | self.keys[d + 1] & 255
            self.keys[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            self.n[d] = np.bincount(self.up[d + 1], self.n[d + 1], len(self.keys[d])).astype(np.int64)

    def nodes(self, bit: int) -> dict[int, tuple]:
        """By depth: first string and number of the node of each string, zeros, ones, odds to stay, weight, from the leaves up."""
        out = {}
        for d in range(self.depth, 1, -1):
            keys, n = self.keys[d], self.n[d]
            head = keys >> (8 - bit)
            new = np.concatenate([[True], head[1:] != head[:-1]])
            first, node = np.flatnonzero(new), np.cumsum(new) - 1
            ones = np.add.reduceat(n * (keys >> (7 - bit) & 1), first)
            zeros = np.add.reduceat(n, first) - ones
            own = self.estimate(zeros, ones)
            if d == self.depth:
                weight, stay = own, np.ones(len(own))
            else:
                child = out[d + 1]
                weight, stay = mixed(own, np.bincount(node[self.up[d + 1][child[0]]], child[5], len(own)))
            out[d] = (first, node, zeros, ones, stay, weight)
        return out

    def above(self, first: np.ndarray, bit: int) -> np.ndarray:
        """The node of depth 1 above each node of depth 2."""
        keys = self.keys[2][first]
        return (keys >> 16) * 256 + ((256 | keys & 255) >> (8 - bit))

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all nodes of depth 1: zeros, ones and the weights of the children that are here."""
        zeros, ones, below = np.zeros(NODES, np.int64), np.zeros(NODES, np.int64), np.zeros(NODES)
        for bit in range(8):
            first, _, a, b, _, weight = self.nodes(bit)[2]
            at = self.above(first, bit)
            zeros += np.bincount(at, a, NODES).astype(np.int64)
            ones += np.bincount(at, b, NODES).astype(np.int64)
            below += np.bincount(at, weight, NODES)
        return zeros, ones, below

    def scores(self, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 probability of each string's last byte, given what the depths 0 and 1 bring (mixed so far, rest, ended there)."""
        out = np.zeros(len(self.keys[self.depth]))
        for bit in range(8):
            nodes = self.nodes(bit)
            so_far, rest, p = (x[self.above(nodes[2][0], bit)] for x in top)
            for d in range(2, self.depth + 1):
                first, node, zeros, ones, stay, _ = nodes[d]
                if d > 2:
                    parent = nodes[d - 1][1][self.up[d][first]]
                    so_far, rest, p = so_far[parent], rest[parent], p[parent]
                one = (ones + 0.5) / (zeros + ones + 1)
                p = np.where(zeros + ones > 0, so_far + rest * one, p)
                so_far, rest = so_far + rest * stay * one, rest * (1 - stay)
            p = p[nodes[self.depth][1]]
            out += np.log10(np.where(self.keys[self.depth] >> (7 - bit) & 1 == 1, p, 1 - p))
        return out


def top_of(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the depths 0 and 1 bring to each node of depth 1: the mixture so far, the share left for deeper nodes, and the
    probability of a one where the path ends."""
    estimate = Estimate()
    weight, stay1 = mixed(estimate(zeros, ones), below)
    root0, root1, children = (x.reshape(256, 256).sum(0) for x in (zeros, ones, weight))
    _, stay0 = mixed(estimate(root0, root1), children)
    one0 = (root1 + 0.5) / (root0 + root1 + 1)
    so_far, rest, p = (np.tile(x, 256) for x in (stay0 * one0, 1 - stay0, one0))
    one1 = (ones + 0.5) / (zeros + ones + 1)
    p = np.where(zeros + ones > 0, so_far + rest * one1, p)
    return so_far + rest * stay1 * one1, rest * (1 - stay1), p


def dealt(distinct: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by part (and string, as given) and where each part begins."""
    part = part_of(distinct, parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def counted(texts: list[bytes], learned: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of a block, in order, and how often the learned texts hold each."""
    found, number = [], []
    for a, b in parts_of(texts):
        key, _ = keys_of(texts[a:b], depth)
        own = np.repeat(learned[a:b], [len(t) + 1 for t in texts[a:b]])
        for some, weight in ((key[own], 1), (key[~own], 0)):
            some.sort()
            first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]])) if len(some) else np.zeros(0, np.int64)
            found.append(some[first])
            number.append(weight * np.diff(first, append=len(some)))
    found, number = np.concatenate(found), np.concatenate(number)
    order = np.argsort(found, kind="stable")
    found, number = found[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[first], np.add.reduceat(number, first)


class Strings:
    """The distinct strings of a block, in order, and the codes of its texts."""

    def __init__(self, texts: list[bytes], depth: int):
        self.texts = []
        for a, b in parts_of(texts):
            codes, distinct, starts = grams(texts[a:b], depth)
            self.texts.append((codes.astype(np.int32), distinct, starts))
        every = np.concatenate([x[1] for x in self.texts])
        every.sort()
        self.distinct = every[np.concatenate([[True], every[1:] != every[:-1]])]

    def sums(self, scores: np.ndarray) -> np.ndarray:
        """Along each text, the sum of its strings' scores (given in the order of ``distinct``)."""
        out = []
        for codes, distinct, starts in self.texts:
            out.append(np.add.reduceat(scores[np.searchsorted(self.distinct, distinct)][codes], starts))
        return np.concatenate(out)


def words_by_part(words: dict[bytes, int], parts: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for w in words:
        out[zlib.crc32(w) % parts].append(w)
    for mine in out:
        mine.sort()
    return out


def joined(words: list[bytes]) -> bytes:
    data = b"\n".join(words)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def split(data: bytes) -> list[bytes]:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True).split(b"\n") if size else []


def record(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def blocks_of(rows: DataFrame) -> DataFrame:
    """The rows (id, learned, text, row) joined to blocks, stored: number of the first row, learned rows, bytes, rows."""
    schema = schema_of(BLOCKS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            first, learned = table.column("row")[0].as_py(), pc.sum(table.column("learned").cast(pa.int64())).as_py()
            held.clear()
            return record(schema, [first], [learned], [size + len(table)], [packed_table(table.select(["id", "learned", "text"]))])

        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            start = 0
            for k, n in enumerate(sizes.tolist()):
                size += n
                if size >= BLOCK:
                    held.append(batch.slice(start, k + 1 - start))
                    yield made()
                    start, size = k + 1, 0
            if start < len(batch):
                held.append(batch.slice(start))
        if held:
            yield made()

    return stored(rows.mapInArrow(join, BLOCKS), "lm-blocks")


def texts_and_marks(data: bytes) -> tuple[pa.Table, list[bytes], np.ndarray]:
    table = unpacked_table(data)
    return table, [t.lower() for t in table.column("text").to_pylist()], table.column("learned").to_numpy()


def scored(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row of ``docs``.

    ``learn`` says which rows the model is learned from; ``depth`` is 2 to 6.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learned"), text.alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    blocks = blocks_of(rows)
    facts = blocks.agg(F.sum("size").alias("size"), F.sum("learned").alias("ends")).first()
    parts, ends = min(PARTS, max(1, math.ceil((facts["size"] or 0) / PART_BYTES))), facts["ends"] or 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(COUNTS)
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, texts, learned = texts_and_marks(data.as_py())
                strings, n = counted(texts, learned, depth)
                order, cuts = dealt(strings, parts)
                strings, n = strings[order], n[order]
                words: Counter = Counter()
                for t, own in zip(texts, learned):
                    words.update(t.split() if own else dict.fromkeys(t.split(), 0))
                for part, mine in enumerate(words_by_part(words, parts)):
                    a, b = cuts[part], cuts[part + 1]
                    steps = np.diff(strings[a:b], prepend=0)
                    found = np.array([words[w] for w in mine], np.int64)
                    yield record(schema, [part], [block], [packed(steps)], [packed(n[a:b])], [joined(mine)], [packed(found)])

    def subtree(sent: pa.Table) -> tuple[Subtree, list[np.ndarray]]:
        """A part's tree, and where each block's strings are in it."""
        each = [np.cumsum(unpacked(x, np.int64)) for x in sent.column("grams").to_pylist()]
        number = np.concatenate([unpacked(x, np.int64) for x in sent.column("counts").to_pylist()])
        strings, at = np.unique(turned(np.concatenate(each), depth), return_inverse=True)
        total = np.bincount(at, number, len(strings)).astype(np.int64)
        return Subtree(strings, total, depth), np.split(at, np.cumsum([len(x) for x in each])[:-1])

    def build(key: tuple, sent: pa.Table) -> pa.Table:
        tree, _ = subtree(sent)
        sums = tree.sums() if len(tree.keys[depth]) else [np.zeros(NODES, np.int64), np.zeros(NODES, np.int64), np.zeros(NODES)]
        return pa.Table.from_batches([record(schema_of(SUBTREES), [key[0].as_py()], [packed_table(sent)], *([packed(x)] for x in sums))])

    sent = blocks.select("block", "rows").mapInArrow(count, COUNTS)
    subtrees = stored(sent.groupBy("part").applyInArrow(build, SUBTREES), "lm-parts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros, ones, below = np.zeros(NODES, np.int64), np.zeros(NODES, np.int64), np.zeros(NODES)
        for batch in batches:
            for a, b, w in zip(*(batch.column(k).to_pylist() for k in range(3))):
                zeros += unpacked(a, np.int64)
                ones += unpacked(b, np.int64)
                below += unpacked(w, np.float64)
        at = np.flatnonzero(zeros + ones)
        yield record(schema_of("node int, a long, b long, w double"), at, zeros[at], ones[at], below[at])

    sums = subtrees.select("zeros", "ones", "below").mapInArrow(spread, "node int, a long, b long, w double")
    sums = sums.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("w"))
    zeros, ones, below = np.zeros(NODES, np.int64), np.zeros(NODES, np.int64), np.zeros(NODES)
    for r in sums.collect():  # at most NODES rows
        zeros[r.node], ones[r.node], below[r.node] = r.a, r.b, r.w
    top = spark.sparkContext.broadcast(top_of(zeros, ones, below))  # three arrays of NODES doubles

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ANSWERS)
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                sent = unpacked_table(data.as_py())
                tree, at = subtree(sent)
                scores = tree.scores(top.value).astype(np.float32) if len(tree.keys[depth]) else np.zeros(0, np.float32)
                words: Counter = Counter()
                lists = [split(x) for x in sent.column("words").to_pylist()]
                for mine, n in zip(lists, sent.column("word_counts").to_pylist()):
                    for w, c in zip(mine, unpacked(n, np.int64).tolist()):
                        words[w] += c
                tokens, kinds = words.total(), sum(c > 0 for c in words.values())
                for block, where, mine in zip(sent.column("block").to_pylist(), at, lists):
                    found = np.array([words[w] for w in mine], np.int64)
                    yield record(schema, [block], [part], [tokens], [kinds], [packed(scores[where])], [packed(found)])

    def score(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        table, texts, learned = texts_and_marks(block.column("rows")[0].as_py())
        answers = answers.sort_by("part")
        strings = Strings(texts, depth)
        lp = np.empty(len(strings.distinct))
        lp[dealt(strings.distinct, parts)[0]] = np.concatenate([unpacked(x, np.float32) for x in answers.column("scores").to_pylist()])
        scores = strings.sums(lp)
        del strings, lp
        # words as numbers, in the order in which they come
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        each = [np.fromiter(map(number.__getitem__, t.split()), np.int64) for t in texts]
        total = np.zeros(len(number), np.int64)
        for mine, n in zip(words_by_part(number, parts), answers.column("word_counts").to_pylist()):
            total[[number[w] for w in mine]] = unpacked(n, np.int64)
        tokens, kinds = pc.sum(answers.column("tokens")).as_py() + ends, pc.sum(answers.column("kinds")).as_py() + (ends > 0)
        below = math.log10(tokens + 0.5 * (kinds + 1))
        logs, end = np.log10(total + 0.5) - below, math.log10(ends + 0.5) - below
        n_tokens = [len(x) + 1 for x in each]
        n_known = [int(np.count_nonzero(total[x])) + (ends > 0) for x in each]
        base = [float(logs[x].sum()) + end for x in each]
        columns = [table.column("id"), table.column("learned"), n_tokens, n_known, [tokens] * len(texts), base, scores, list(map(len, texts))]
        schema = schema_of(SCORES)
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    answered = subtrees.select("part", "sent").mapInArrow(answer, ANSWERS)
    out = blocks.select("block", "rows").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, SCORES)
    bits = -F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))
    return out.select("id", "learned", "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), "score", bits.alias("bits_per_byte"))
