"""Best-fit packing by bin completion: branch and bound over fillings, on counts per length.

Pieces of one length may stand for each other, so how many pieces there are of
each length (at most ``size`` numbers, whatever the corpus holds) is all that
the search needs. A node of the search takes the longest length left, lists the
undominated fillings of the room beside it, least waste first, and branches on
one filling in as many sequences as the counts allow (then in fewer). It is cut
where the sequences used and the lower bound of the rest reach the incumbent, or
where a filling wastes more than the incumbent leaves. The first incumbent is
best-fit decreasing; each better end of a branch replaces it. The search ends
when the incumbent meets the lower bound, when the tree is exhausted (then the
incumbent is optimal), or after ``node_limit`` nodes; the incumbent always holds
every piece.

Spark does the rest: tasks tokenise and number their pieces within each length,
a prefix sum over the tasks turns that into one numbering per length, and each
piece finds its sequence and place from its number by a search in the plan's
ranges. The ranges are bounded by the sequence size (a filling has at most
sqrt(2 * size) different lengths, and each step of a plan uses one up or lowers
the copies of it that fit), so they may go to every task.

Defined results: a null text counts as empty, so its document is the end id
alone; repeated rows are packed separately; a null id stays null; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.bpe import PATTERN, RankBPE
from docweave.llm.bpe_codec import TextCodec
from docweave.llm.common import arrow_batch, id_and_text, slices, written

SEQUENCE = 2048
NODE_LIMIT = 5_000  # nodes of the search; beyond it the incumbent stands
BREADTH = 12        # fillings that a node branches on

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on counts: (contents, number of sequences with them).

    Sequences with equal contents are kept as one group; a length goes to the
    groups with the least room that still holds it, as many copies as fit.
    """
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []
    full: list[tuple[Filling, int]] = []

    def put(room: int, held: Filling, bins: int) -> None:
        if room == 0:
            full.append((held, bins))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([held, bins])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                held, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, held, bins = size, (), left  # as many new ones as could be needed
            each = room // length
            whole = min(bins, left // each)
            if whole:
                put(room - each * length, (*held, (length, each)), whole)
            left -= whole * each
            rest = bins - whole
            if rest and left and left < each:
                put(room - left * length, (*held, (length, left)), 1)
                left, rest = 0, rest - 1
            if rest and held:
                put(room, held, rest)
    return full + [(held, bins) for groups in open_.values() for held, bins in groups]


def lower_bound(counts: np.ndarray, size: int) -> int:
    """No fewer sequences can hold ``counts`` (copies by length, index 0 unused).

    For each threshold t: lengths over size - t stand alone, lengths over half of
    the size stand apart, and lengths from t on only use the room beside the latter.
    """
    lengths = np.arange(size + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * lengths)
    half = size // 2
    t = np.arange(1, half + 1)
    alone = number[size] - number[size - t]
    apart = number[size - t] - number[half]
    room = apart * size - (total[size - t] - total[half])
    small = total[half] - total[t - 1]
    by_t = alone + apart + np.maximum(0, -((room - small) // size))
    return int(max(by_t.max(), -(-int(total[size]) // size)))


def _spread(mask: int, width: int) -> int:
    """The bits of ``mask`` and the ``width`` places above each."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        mask |= mask << step
        done += step
    return mask


def dominated(filling: Filling, counts: np.ndarray, room: int, free: int) -> bool:
    """Whether a length left out could take the place of one or more of the filling's pieces.

    ``free`` has a bit for each length there is. The filling is dominated if pieces
    that sum to s can give way to one of x, s <= x, without overflow (for a single
    piece: s < x). What they leave can only be easier to place.
    """
    one = many = used = 0
    for length, copies in filling:
        used += length * copies
        if counts[length] == copies:
            free &= ~(1 << length)
        for _ in range(copies):
            many |= (one | many) << length
            one |= 1 << length
    slack = room - used
    if free & _spread(many, slack):
        return True
    return bool(slack and free & _spread(one << 1, slack - 1))


def fillings(counts: np.ndarray, room: int, waste: int, breadth: int) -> list[Filling]:
    """Up to ``breadth`` undominated fillings of ``room`` that waste at most ``waste``, least waste first, longest lengths first."""
    lengths = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1] if x]
    if not lengths:
        return [()] if room <= waste else []
    mask = (1 << (room + 1)) - 1
    free = sum(1 << x for x in lengths)
    held = counts.tolist()
    reach = [1] * (len(lengths) + 1)  # sums that lengths[i:] can make
    bits = 1
    for i in range(len(lengths) - 1, -1, -1):
        left, step = min(held[lengths[i]], room // lengths[i]), 1
        while left:
            step = min(step, left)
            bits |= bits << (step * lengths[i])
            left -= step
            step *= 2
        bits &= mask
        reach[i] = bits

    def exact(i: int, target: int) -> Iterator[Filling]:
        for j in range(i, len(lengths)):
            if not reach[j] >> target & 1:
                return
            length = lengths[j]
            for copies in range(min(held[length], target // length), 0, -1):
                rest = target - copies * length
                if rest == 0:
                    yield ((length, copies),)
                elif reach[j + 1] >> rest & 1:
                    for more in exact(j + 1, rest):
                        yield ((length, copies), *more)

    found, tried = [], 0
    for target in range(room, max(0, room - waste) - 1, -1):
        if target == 0 or not reach[0] >> target & 1:
            continue
        for filling in exact(0, target):
            tried += 1
            if not dominated(filling, counts, room, free):
                found.append(filling)
            if len(found) == breadth or tried == 20 * breadth:
                return found
    return found


def plan(counts: dict[int, int], size: int = SEQUENCE, node_limit: int = NODE_LIMIT, breadth: int = BREADTH) -> list[tuple[Filling, int]]:
    """How to fill sequences with ``counts`` pieces by length: (contents, number of sequences)."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} does not fit a sequence of {size}")
        left[length] = n
    best = best_fit({k: n for k, n in counts.items() if n}, size)
    fewest = sum(n for _, n in best)
    bound = lower_bound(left, size)
    lengths = np.arange(size + 1)

    def branches(used: int) -> Iterator[tuple[Filling, int]]:
        """What may stand beside the longest length, given the incumbent."""
        longest = int(np.flatnonzero(left)[-1])

        def choices(number: int) -> list[tuple[Filling, int]]:
            waste = (fewest - 1 - used) * size - int(left @ lengths)
            left[longest] -= 1
            beside = fillings(left, size - longest, waste, number) if waste >= 0 else []
            left[longest] += 1
            out = []
            for filling in beside:
                contents = dict(filling)
                contents[longest] = contents.get(longest, 0) + 1
                whole = tuple(sorted(contents.items(), reverse=True))
                out.append((whole, min(int(left[k]) // c for k, c in whole)))
            return out

        yield from choices(1)
        more = choices(breadth)  # only reached on the way back, with the same counts
        yield from more[1:]
        for whole, most in more:
            for n in range(most - 1, 0, -1):
                yield whole, n

    path: list[tuple[Filling, int]] = []
    stack = [branches(0)] if fewest > bound else []
    used = nodes = 0
    while stack and nodes < node_limit and fewest > bound:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                filling, n = path.pop()
                used -= n
                for k, c in filling:
                    left[k] += c * n
            continue
        nodes += 1
        filling, n = step
        path.append(step)
        used += n
        for k, c in filling:
            left[k] -= c * n
        if not left.any():
            if used < fewest:
                best, fewest = list(path), used
            stack.append(iter(()))
        elif used + lower_bound(left, size) < fewest:
            stack.append(branches(used))
        else:
            stack.append(iter(()))
    return best


def ranges(chosen: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """The plan as ranges of piece numbers, pieces being numbered by length, then within it.

    Number i in a range stands in sequence ``sequence + (i - low) // copies`` at
    ``offset + length * ((i - low) % copies)``.
    """
    rows, sequence = [], 0
    for filling, n in chosen:
        offset = 0
        for length, copies in filling:
            rows.append((length, sequence, copies, offset, n * copies))
            offset += length * copies
        sequence += n
    rows.sort()
    length, seq, copies, offset, number = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5))
    return {"low": np.cumsum(number) - number, "length": length, "sequence": seq, "copies": copies, "offset": offset}


class Encoder:
    """Ids as the library gives them for the byte-level vocabulary ``path``, its special strings included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        ranks = RankBPE.load(path)
        self.codec = TextCodec(ranks)
        self.special = special
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks.ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except ValueError:  # a run of white space too long for the regex engine: encoded by halves instead
            parts = self.parts.split(text) if self.parts else [text]
            return np.array([i for p in parts for i in ([self.special[p]] if p in self.special else self.codec.encode(p))], "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(df: DataFrame, vocabulary_path: str, end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, task, number, ids): number counts a task's pieces of that length.

    A document over ``size`` is cut into whole sequences, the first piece taking what is over.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("number", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path).ids
        task = TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4").tobytes()
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    length = (total - start) % size or size
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(part), task, seen[length]) + ((part,) if with_ids else ()))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            if rows:
                yield arrow_batch(schema, list(map(list, zip(*rows, strict=True))))

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids binary" * with_ids
    return id_and_text(df, id_col, text_col).mapInArrow(run, ddl)


def pack_by_completion(df: DataFrame, vocabulary_path: str, end_id: int = 0, size: int = SEQUENCE, with_ids: bool = False, node_limit: int = NODE_LIMIT, breadth: int = BREADTH, **columns) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids)."""
    pieces = written(token_pieces(df, vocabulary_path, end_id, size, with_ids=with_ids, **columns), "pieces")
    by_task = written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length: at most ``size``
    held = ranges(plan(counts, size, node_limit, breadth))
    first = np.zeros(size + 2, np.int64)
    for length, n in counts.items():
        first[length + 1] = n
    first = np.cumsum(first)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["task", "length"]).withColumn("number", F.col("number") + F.col("base")).drop("base", "task")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            number = first[c["length"].to_numpy()] + c["number"].to_numpy()
            at = np.searchsorted(held["low"], number, "right") - 1
            inside = number - held["low"][at]
            c["sequence_id"] = pa.array(held["sequence"][at] + inside // held["copies"][at])
            c["offset"] = pa.array(held["offset"][at] + inside % held["copies"][at] * held["length"][at])
            yield pa.RecordBatch.from_arrays([c[n] for n in names], names)

    return numbered.mapInArrow(run, ddl)
