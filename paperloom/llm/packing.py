"""Mixture-controlled packing of all documents into sequences of a fixed number of tokens.

Every source is a queue of tokens, however many there are. The queues are the leaves of a binary tree, heaviest first, each
node cut where its weight is nearest to halved. Of the first m tokens of a node, its left child sends m times its share,
rounded half up, and the right child the rest: all of these counts only grow, and they add up to m. Deficits are thus carried
from window to window without being passed on, and the first k windows hold k * window tokens of which every queue has sent its
share to within two tokens, since no child of two leaves or more has over two thirds of its parent. Within a window, queues
follow each other in the order of the tree. A round holds until a queue runs dry; the rest then share anew. Queues without weight
wait until those with weight are dry and then share by what they have. The driver keeps a few numbers per queue and round.

Positions are exact without passing documents through one place: each task counts its queues from zero while it writes
token ids, and the totals per (task, queue) give where the task's queues begin, so deficits carry across partitions as well.
Every document then computes its own pieces; token ids are shuffled only if totals per (task, queue) are too many to be broadcast.

Null and empty texts are one end id. A null source is a queue of its own. Repeated rows are packed repeatedly. An empty table
gives no pieces. Only the last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scale import broadcast_if_small
from paperloom.llm.common import give_back_memory
from paperloom.llm.tokens import END_ID, by_size, definition_of, shared_tokenizer
from paperloom.session import new_folder, stored

WINDOW = 2048
WEIGHT_UNIT = 1 << 24
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class Round:
    """``length`` tokens after the first ``first``. Its ``queues``, heaviest first, had ``sent`` as many tokens before.

    ``ends`` are the running sums of their weights, with a zero in front.
    """

    first: int
    length: int
    queues: np.ndarray
    sent: np.ndarray
    ends: np.ndarray

    def path(self, member: int) -> list[tuple[int, int, bool]]:
        """From the root to a leaf: the weight of the node, that of its left child, and whether the way goes left."""
        low, high, steps = 0, len(self.queues), []
        while high - low > 1:
            start, end = int(self.ends[low]), int(self.ends[high])
            cut = int(np.searchsorted(self.ends[low + 1 : high], (start + end) // 2)) + low + 1
            if cut == high or (cut > low + 1 and start + end - 2 * int(self.ends[cut - 1]) <= 2 * int(self.ends[cut]) - start - end):
                cut -= 1
            left = member < cut
            steps.append((end - start, int(self.ends[cut]) - start, left))
            low, high = (low, cut) if left else (cut, high)
        return steps

    def fits(self, dtype: type) -> bool:
        """Whether twice a number of tokens times a weight can be held."""
        return 2 * (self.length + 1) * int(self.ends[-1]) <= np.iinfo(dtype).max


def _sent(path: list[tuple[int, int, bool]], m):
    """Of the first ``m`` tokens, how many the queues in front of a leaf have sent, and how many its own."""
    before = m * 0
    for whole, left, to_left in path:
        part = (2 * m * left + whole) // (2 * whole)
        if to_left:
            m = part
        else:
            before, m = before + part, m - part
    return before, m


def _position(path: list[tuple[int, int, bool]], i):
    """Place in the round of the leaf's token number ``i``."""
    for whole, left, to_left in reversed(path):
        if to_left:
            i = -(-(2 * i + 1) * whole // (2 * left)) - 1
        else:
            i = (2 * i + 1) * whole // (2 * (whole - left))
    return i


def plan_rounds(totals: list[int], weights: list[int], window: int = WINDOW) -> list[Round]:
    """Rounds that send all ``totals``, whatever the window; a queue without weight waits until those with weight are dry."""
    left, totals, weights = (np.array(x, dtype=np.int64) for x in (totals, totals, weights))
    rounds, first = [], 0
    while left.any():
        live = np.flatnonzero((left > 0) & (weights > 0))
        if live.size:
            shares = weights[live]
        else:  # all run dry together
            live = np.flatnonzero(left)
            shares = left[live]
        order = np.argsort(-shares, kind="stable")
        live, shares = live[order], shares[order]
        made = Round(first, int(left[live].sum()), live, (totals - left)[live], np.append(0, np.cumsum(shares)))
        if not np.array_equal(shares, left[live]):
            paths = [made.path(j) for j in range(len(live))]
            dry = min(_position(p, n) for p, n in zip(paths, left[live].tolist(), strict=True))
            made = replace(made, length=min(made.length, dry))
            left[live] -= np.array([_sent(p, made.length)[1] for p in paths], dtype=np.int64)
        else:
            left[live] = 0
        rounds.append(made)
        first += made.length
    return rounds


class Schedule:
    """Finds the pieces of a stretch of one queue's tokens."""

    def __init__(self, rounds: list[Round], window: int = WINDOW):
        self.rounds, self.window = rounds, window
        self.orders = [np.argsort(r.queues) for r in rounds]
        self.known: dict[int, list[tuple]] = {}

    def _turns(self, queue: int) -> list[tuple]:
        """The rounds of a queue: the round, the queue's path, and what it has sent before and after."""
        if queue not in self.known:
            found = []
            for r, order in zip(self.rounds, self.orders, strict=True):
                at = int(np.searchsorted(r.queues, queue, sorter=order))
                if at < len(order) and r.queues[order[at]] == queue:
                    path, sent = r.path(order[at]), int(r.sent[order[at]])
                    found.append((r, path, sent, sent + _sent(path, r.length)[1], np.int64 if r.fits(np.int64) else object))
            self.known[queue] = found
        return self.known[queue]

    def pieces(self, queue: int, start: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the pieces in order, the windows they go to, and their places there."""
        found, stop = [], start + length
        for r, path, sent, after, kind in self._turns(queue):
            inside, total = max(start, sent) - sent, min(stop, after) - sent
            if inside >= total:
                continue
            low, high = ((r.first + _position(path, i)) // self.window for i in (inside, total - 1))
            if high - low < total - inside:
                k = np.arange(low, high + 1, dtype=np.int64)
            else:  # a small share: most windows between hold none of it
                at = _position(path, np.arange(inside, total, dtype=np.int64).astype(kind))
                k = np.unique((r.first + at).astype(np.int64) // self.window)
            edges = np.clip(np.concatenate((k, k + 1)) * self.window - r.first, 0, r.length)
            before, own = (x.astype(np.int64) for x in _sent(path, edges.astype(kind)))
            n = len(k)
            take_from, take_to = np.maximum(own[:n], inside), np.minimum(own[n:], total)
            some = np.flatnonzero(take_to > take_from)
            place = r.first + edges[:n] - k * self.window + before[n:] - before[:n] + take_from - own[:n]
            found.append(((take_to - take_from)[some], k[some], place[some]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _encoded(docs: DataFrame, definition: str) -> DataFrame:
    """doc_id, queue, ids, n, and the task with the place of the document among the tokens of its queue there."""

    schema = "doc_id string, queue long, task long, begin long, n long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, sent, task = shared_tokenizer(definition), {}, TaskContext.get().partitionId()
        for whole in batches:
            for batch in by_size(whole, "text"):
                ids, n = tokenizer.encode_batch(batch.column("text"))
                ids, n = np.insert(ids, np.cumsum(n), END_ID).astype("<u2"), n + 1
                begin = []
                for queue, length in zip(batch.column("queue").to_pylist(), n.tolist(), strict=True):
                    begin.append(sent.get(queue, 0))
                    sent[queue] = begin[-1] + length
                edges = (2 * np.append(0, np.cumsum(n))).astype(np.int32)
                columns = [
                    batch.column("doc_id"),
                    batch.column("queue"),
                    pa.array([task] * len(n), pa.int64()),
                    pa.array(begin, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(ids)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "queue", "task", "begin", "n", "ids"])
        give_back_memory()

    # ids travel as text, which keeps large ones exact beside nulls
    return docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(encode, schema)


def _queues(docs: DataFrame) -> DataFrame:
    """Number of the queue by source, not without gaps: 0 is the null source."""
    names = docs.select(F.col("source").alias("name")).where("name is not null").distinct()
    return stored(names.withColumn("queue", F.monotonically_increasing_id() + 1), "queues")


def pieces(
    docs: DataFrame, tokenizer_path: str, targets: dict[str, float] | None = None, window: int = WINDOW
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the token ids of the piece as 32-bit little-endian numbers. The pieces of a sequence in order of their
    offsets are the sequence; see :func:`sequences`.

    ``targets`` gives the proportion of tokens per source, the sources not named having none until the others are dry;
    without it, the proportions are those of the corpus, so that all queues run dry together.
    """
    spark, queues = docs.sparkSession, _queues(docs)
    # one row per source
    rows = docs.select("doc_id", "text", F.col("source").alias("name")).join(broadcast_if_small(queues), "name", "left")
    path = new_folder(spark, "token-ids")
    encoded = _encoded(rows.select("doc_id", "text", F.coalesce("queue", F.lit(0)).alias("queue")), definition_of(tokenizer_path))
    encoded.write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)

    by_task = stored(encoded.groupBy("queue", "task").agg(F.sum("n").alias("n")), "queue-totals")
    earlier = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(by_task.select("queue", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "queue-begins")

    sums = by_task.groupBy("queue").agg(F.sum("n").alias("n")).toArrow().sort_by("queue")
    numbers, totals = (sums.column(c).to_numpy() for c in ("queue", "n"))
    if targets is None:
        weights = totals
    else:
        shares = {r["queue"]: targets[r["name"]] for r in queues.where(F.col("name").isin(list(targets))).collect()}
        most = sum(shares.values()) or 1
        weights = [max(1, round(s * WEIGHT_UNIT / most)) if (s := shares.get(q)) else 0 for q in numbers.tolist()]
    schedule = Schedule(plan_rounds(totals, weights, window), window)

    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # ids are twice as wide when they leave, so a few documents at a time
            for batch in (whole.slice(i, ROWS_AT_ONCE) for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
                queue = np.searchsorted(numbers, batch.column("queue").to_numpy()).tolist()
                found = [schedule.pieces(*x) for x in zip(queue, batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True)]
                lengths, sequence, place = (np.concatenate(x) for x in zip(*found, strict=True))
                owner = np.repeat(np.arange(batch.num_rows), [len(x[0]) for x in found])
                ends, tokens = np.cumsum(lengths), batch.column("n").to_numpy()
                start = ends - lengths - (np.cumsum(tokens) - tokens)[owner]
                ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype="<u2").astype("<u4")
                edges = (4 * np.append(0, ends)).astype(np.int32)
                cut_ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(lengths), cut_ids,
                     pa.array(tokens[owner]), pa.array(sequence), pa.array(place)],
                    columns,
                )
        give_back_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = encoded.join(broadcast_if_small(begins), ["queue", "task"]).select(
        "doc_id", "queue", (F.col("before") + F.col("begin")).alias("at"), "n", "ids"
    )
    packed = placed.mapInArrow(
        cut, "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences, from their pieces: sequence_id, n_tokens, ids."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return joined.select("sequence_id", ids.alias("ids")).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def pack(
    docs: DataFrame, tokenizer_path: str, targets: dict[str, float] | None = None, window: int = WINDOW
) -> DataFrame:
    """The pieces with the CRC-32 of their ids as ids_crc32 in place of them."""
    packed = pieces(docs, tokenizer_path, targets, window)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
