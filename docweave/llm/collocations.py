"""Collocations by dynamic itemset counting over cyclic scans of shards.

The rows are dealt to a few shards and the shards are scanned in a cycle, one a
step. All lengths are counted in the same scans: words from the first step on,
a longer phrase from the step after both its subphrases (all but the last word,
all but the first) have been counted ``least`` times, and each for one full
cycle, so whatever shard it began with, every shard counts once. The scans end
when every phrase that became active has had its cycle; a phrase that occurs
``least`` times always becomes active, as its subphrases occur as often.

The scans count hash values. A task sends its active phrases as arrays of hash
values and counts, one row for each of many ranges of hash values; a shuffle
brings a range's arrays together, which are added up and written to the shared
folder. Which values have reached ``least`` is read off the sums of all steps so
far and told to the tasks as a table of fixed size: for each of 2^22 hash values
the first step at which a phrase with it may count. One more scan then counts, by
their words, the phrases whose value has reached ``least`` over the whole cycle.
A shared hash value can bring in a phrase that need not be counted, but loses
none and adds nothing to another's count, so counts are exact.

Defined results: a null text counts as empty, a null language as ``und``;
repeated rows count again; an empty table gives no rows; only the two columns
are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import scratch, slices, written
from docweave.llm.wordhash import mix

SHARDS = 3
LEAST = 10            # occurrences of a candidate
INSIDE_PERCENT = 50   # a longer candidate with this share of a phrase's occurrences drops it
TOP = 2000
BITS = 22
FINAL_BITS = 26       # of the table that the last scan looks phrases up in
RANGE_BYTES = 4 << 20  # text for each range of hash values
RANGE_BITS = 18       # of a range's part of the tables that tell which sums are added up over the steps
SALTS = {1: 16}       # copies of a word's count in lookups: many candidates share a word
SALTS_LONGER = 2
_NEVER = 255
_MOST = 255           # a count sent with a hash value is a byte
_REST = 26            # bits of a hash value that are sent, beside those of its range
_HELD = 2_000_000     # hash values that a task sorts at once
_NAMES = 600_000      # names that a task holds
_NAME_RANGES = 10     # at most, as bits
_SLICE = 4 << 20
_STEP_MUL, _WORD_ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
_BREAK = b"\xff"      # a byte that no UTF-8 text holds
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)


class _Numbers(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _word_hashes(prefix: bytes, words: list[bytes]) -> np.ndarray:
    start = zlib.crc32(prefix)
    crc = zlib.crc32
    return mix(np.fromiter((crc(w, start) for w in words), np.uint64, len(words)) + _WORD_ADD)


def _longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash values of phrases followed by one more word."""
    return mix(hashes * _STEP_MUL + word)


def _entry(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _entries(prefix: bytes, phrases: list[bytes]) -> np.ndarray:
    """Places of a language's phrases in the tables of 2^BITS hash values."""
    out = []
    for phrase in phrases:
        words = _word_hashes(prefix, phrase.split(b" "))
        out.append(reduce(_longer, (words[i : i + 1] for i in range(len(words)))))
    return _entry(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _has(bits: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return (bits[entry >> 3] >> (entry & 7).astype(np.uint8)) & 1 != 0


def _slice_phrases(lang: str, texts: list[bytes], longest: int, told: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], list[bytes]]]]:
    """(words, hash values, counts, first steps, names) of the phrases of a slice, by length.

    ``told(words, hash values)`` gives the first steps of what they are part of; names of phrases are made when asked for.
    """
    words = _BREAK.join(texts).translate(_TO).replace(_BREAK, b" \xff ").split()
    known = _Numbers()
    known[_BREAK] = 0
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words)) - 1  # -1: a break
    single = list(known)[1:]
    if not single:
        return
    word_hash = hashes = _word_hashes(lang.encode() + b"\0", single)
    last = np.array(single, object)
    final = np.arange(len(single))  # the last word of each phrase
    start = np.zeros(len(single), np.int64)
    chain: list[tuple[np.ndarray, np.ndarray]] = []  # of each length from 2 on: the phrase without its last word, and that word

    def names(length: int, which: np.ndarray) -> list[bytes]:
        parts = []
        for left, word in reversed(chain[: length - 1]):
            parts.append(last[word[which]].tolist())
            which = left[which]
        parts.append(last[which].tolist())
        return list(map(b" ".join, zip(*reversed(parts), strict=True))) if length > 1 else parts[0]

    yield 1, hashes, np.bincount(ids[ids >= 0], minlength=len(single)), start, partial(names, 1)
    for length in range(2, longest + 1):
        # a shared hash value may be told of before the phrase itself can be seen
        since = np.maximum(told(length - 1, hashes), start)
        usable = np.append(since != _NEVER, False)[ids]  # the last place stands for a break
        at = np.flatnonzero(usable[:-1] & usable[1:])
        if not len(at):
            return
        pair = ids[at] * len(hashes) + ids[at + 1]
        if length < longest:
            key, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
            ids = np.full(len(ids) - 1, -1, np.int64)
            ids[at] = inverse
        else:
            key, count = np.unique(pair, return_counts=True)
        left, right = np.divmod(key, len(hashes))
        start = np.maximum(since[left], since[right])
        final = final[right]
        hashes = _longer(hashes[left], word_hash[final])
        chain.append((left, final))
        yield length, hashes, count, start, partial(names, length)


def _active(lang: str, texts: list[bytes], step: int, shards: int, reached: dict[int, np.ndarray], longest: int) -> Iterator[tuple]:
    """What ``_slice_phrases`` gives, and which of the phrases are active in this step."""
    for length, hashes, count, start, names in _slice_phrases(lang, texts, longest, lambda k, h: reached[k][_entry(h)]):
        which = np.flatnonzero((start <= step) & (step < start + shards))
        if len(which):
            yield length, hashes, count, start, names, which


def slice_counts(lang: str, texts: list[bytes], step: int, shards: int, reached: dict[int, np.ndarray], longest: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """(words, phrases, counts, first steps) of the phrases that are active in this step, by length."""
    for length, _, count, start, names, which in _active(lang, texts, step, shards, reached, longest):
        yield length, names(which), count[which], start[which]


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in slices(batches, limit=_SLICE):
        found: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            found.setdefault(lang, []).append(text)
        yield from found.items()


_SENT = "range int, words int, hashes binary, counts binary"
_SENT_ARROW = pa.schema([("range", pa.int32()), ("words", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_SUMS = _SENT + ", likely binary"


def _planes(values: np.ndarray) -> bytes:
    """The lowest byte of all values first: where values are small, the others are nearly all zero."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(sent: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(sent, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _packed(hashes: np.ndarray) -> bytes:
    """Ascending hash values of a range as their differences."""
    return _planes(np.diff(hashes, prepend=hashes.dtype.type(0)).astype("<u4"))


def _unpacked(sent: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(sent, "<u4"), dtype=np.uint32)


def _rows(words: int, ranges: list[int], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(ranges, pa.int32()), pa.array([words] * len(ranges), pa.int32()), pa.array(map(_packed, hashes), pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_SENT_ARROW)


def _by_range(words: int, packed: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Hash values (with counts in their last byte) by the range of their first ``ranges`` bits: the next bits of each, and its count."""
    packed.sort()
    end = np.searchsorted(packed, np.arange(1, 1 << ranges, dtype=np.uint64) << np.uint64(64 - ranges))
    rest = ((packed >> np.uint64(64 - ranges - _REST)) & np.uint64((1 << _REST) - 1)).astype(np.uint32)
    hashes, counts = np.split(rest, end), np.split((packed & np.uint64(255)).astype(np.uint8), end)
    there = [i for i, h in enumerate(hashes) if len(h)]
    return _rows(words, there, [hashes[i] for i in there], [counts[i] for i in there])


def _scan(rows: DataFrame, step: int, shards: int, reached: dict[int, np.ndarray], longest: int, ranges: int, least: int) -> DataFrame:
    """``_SENT`` rows of one shard in one step: hash values of active phrases and their counts, ``least`` at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for lang, texts in _by_lang(batches):
            for length, hashes, count, _, _, which in _active(lang, texts, step, shards, reached, longest):
                own = held.setdefault(length, [])
                own.append((hashes[which] & ~np.uint64(255)) | np.minimum(count[which], least).astype(np.uint64))
                if sum(map(len, own)) > _HELD:
                    yield _by_range(length, np.concatenate(held.pop(length)), ranges)
        for length, own in held.items():
            yield _by_range(length, np.concatenate(own), ranges)

    return rows.mapInArrow(run, _SENT)


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hash values of a range and their counts."""
    hashes = np.concatenate([_unpacked(h) for h in table.column("hashes").to_pylist()])
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
    packed = (hashes.astype(np.uint64) << np.uint64(8)) | counts
    packed.sort()
    hashes = (packed >> np.uint64(8)).astype(np.uint32)
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.add.reduceat((packed & np.uint64(255)).astype(np.int64), first)


def _bits_of(hashes: np.ndarray, bits: int, ranges: int) -> bytes:
    """A range's part of a table of 2^bits bits."""
    own = np.zeros(1 << (bits - ranges), bool)
    own[hashes >> np.uint32(_REST - bits + ranges)] = True
    return np.packbits(own, bitorder="little").tobytes()


def _likely_bits(ranges: int) -> int:
    return min(FINAL_BITS, ranges + RANGE_BITS)


def _step_sums(sent: DataFrame, ranges: int, least: int, share: int) -> DataFrame:
    """The sums of a step, ``least`` at most, and a table of the hash values that have their share of it in this step."""
    def add(table: pa.Table) -> pa.Table:
        hashes, n = _summed(table)
        first = table.slice(0, 1)
        row = [first.column("range"), first.column("words"), pa.array([_packed(hashes)], pa.binary()), pa.array([np.minimum(n, least).astype(np.uint8).tobytes()], pa.binary()), pa.array([_bits_of(hashes[n >= share], _likely_bits(ranges), ranges)], pa.binary())]
        return pa.Table.from_arrays(row, names=["range", "words", "hashes", "counts", "likely"])

    return sent.groupBy("range", "words").applyInArrow(add, _SUMS)


def _tables(rows: DataFrame, column: str, bits: int, ranges: int) -> dict[int, np.ndarray]:
    """Tables of 2^bits bits by length, on the driver."""
    got = rows.select("range", "words", column).toArrow()
    out: dict[int, np.ndarray] = {}
    size = 1 << (bits - ranges - 3)
    for place, words, own in zip(*(c.to_pylist() for c in got.columns), strict=True):
        out.setdefault(words, np.zeros(1 << (bits - 3), np.uint8))[place * size : (place + 1) * size] |= np.frombuffer(own, np.uint8)
    return out


def _reached(sums: DataFrame, likely: dict[int, np.ndarray], least: int, bits: int, ranges: int) -> dict[int, np.ndarray]:
    """Tables of the hash values whose sums have come to ``least``.

    Such a value has its share of them in one step; only values that share a place with one that has are shuffled.
    """
    own = _likely_bits(ranges) - ranges

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, words, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words not in likely:
                    continue
                hashes = _unpacked(hashes)
                at = (place << own) + (hashes >> np.uint32(_REST - own)).astype(np.int64)
                found = _has(likely[words], at)
                if found.any():
                    yield _rows(words, [place], [hashes[found]], [np.frombuffer(counts, np.uint8)[found]])

    def add(table: pa.Table) -> pa.Table:
        hashes, n = _summed(table)
        first = table.slice(0, 1)
        return pa.Table.from_arrays([first.column("range"), first.column("words"), pa.array([_bits_of(hashes[n >= least], bits, ranges)], pa.binary())], names=["range", "words", "bits"])

    found = sums.select("range", "words", "hashes", "counts").mapInArrow(some, _SENT).groupBy("range", "words").applyInArrow(add, "range int, words int, bits binary")
    return _tables(found, "bits", bits, ranges)


def _named(rows: DataFrame, reached: dict[int, np.ndarray], longest: int, ranges: int, all_words: bool) -> DataFrame:
    """(lang, words, phrase, n) of the phrases whose hash value and those of their parts are in the tables, and of all words if so asked.

    The row with 0 words gives the words of a language. A task's phrases are sent sorted and joined, a row for each range of hash values.
    """
    ranges = min(ranges, _NAME_RANGES)
    sent = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("range", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def held(length: int, hashes: np.ndarray) -> np.ndarray:
        return _has(reached[length], _entry(hashes, FINAL_BITS)) if length in reached else np.zeros(len(hashes), bool)

    def told(length: int, hashes: np.ndarray) -> np.ndarray:
        return np.where(held(length, hashes), 0, _NEVER)

    def joined(found: dict[tuple[str, int], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, length), own in found.items():
            phrases = sorted(own)
            counts = np.array([own[p] for p in phrases], "<i8")
            place = np.fromiter(map(zlib.crc32, phrases), np.int64, len(phrases)) >> (32 - ranges)
            order = np.argsort(place, kind="stable")
            there, first = np.unique(place[order], return_index=True)
            parts = [(i, _BREAK.join([phrases[j] for j in part.tolist()]), _planes(counts[part])) for i, part in zip(there.tolist(), np.split(order, first[1:]), strict=True)]
            columns = [[lang] * len(parts), [length] * len(parts), *map(list, zip(*parts, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, sent.types, strict=True)], schema=sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], dict[bytes, int]] = {}
        for lang, texts in _by_lang(batches):
            for length, hashes, count, _, names in _slice_phrases(lang, texts, longest, told):
                which = np.arange(len(hashes)) if all_words and length == 1 else np.flatnonzero(held(length, hashes))
                if length == 1:
                    total = found.setdefault((lang, 0), {b"": 0})
                    total[b""] += int(count.sum())
                if len(which):
                    own = found.setdefault((lang, length), {})
                    get = own.get
                    for phrase, n in zip(names(which), count[which].tolist(), strict=True):
                        own[phrase] = get(phrase, 0) + n
            if sum(map(len, found.values())) > _NAMES:
                yield from joined(found)
                found = {}
        yield from joined(found)

    def add(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for phrases, counts in zip(table.column("phrases").to_pylist(), table.column("counts").to_pylist(), strict=True):
            for phrase, n in zip(phrases.split(_BREAK), _from_planes(counts, "<i8").tolist(), strict=True):
                total[phrase] = total.get(phrase, 0) + n
        n = len(total)
        same = [table.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int32))) for c in ("lang", "words")]
        return pa.Table.from_arrays([*same, pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "words", "phrase", "n"])

    told_of = rows.mapInArrow(run, "lang string, words int, range int, phrases binary, counts binary")
    return told_of.groupBy("lang", "words", "range").applyInArrow(add, "lang string, words int, phrase string, n long")


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def phrase_counts(df: DataFrame, longest: int = 3, least: int = LEAST, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, phrase, n): the exact counts of all words, and of every longer phrase that may occur ``least`` times."""
    return _counts(df, longest, least, shards, lang_col, text_col, all_words=True).where("words > 0")


def _counts(df: DataFrame, longest: int, least: int, shards: int, lang_col: str = "lang", text_col: str = "text", all_words: bool = False) -> DataFrame:
    """(lang, words, phrase, n): exact counts of every phrase that may occur ``least`` times; with 0 words the words of a language."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    source = scratch(spark, "shards")
    rows.withColumn("shard", F.spark_partition_id() % shards).write.partitionBy("shard").parquet(source, compression="zstd")
    dealt = spark.read.schema("lang string, text string, shard int").parquet(source)
    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(16, max(4, (size // RANGE_BYTES).bit_length()))  # as bits of the hash values
    enough = min(least, _MOST)  # more may pass with a least number above a byte; names are counted whole
    share = -(-enough // shards)
    reached = {length: np.full(1 << BITS, _NEVER, np.uint8) for length in range(1, longest)}
    likely: dict[int, np.ndarray] = {}
    sums: list[DataFrame] = []
    paths = [source]
    step, until = 0, shards
    while step < until:
        shard = dealt.where(F.col("shard") == step % shards).select("lang", "text")
        paths.append(scratch(spark, "hash-sums"))
        _step_sums(_scan(shard, step, shards, reached, longest, ranges, enough), ranges, enough, share).write.partitionBy("words").parquet(paths[-1], compression="zstd")
        sums.append(spark.read.schema(_SUMS).parquet(paths[-1]))
        for length, own in _tables(sums[-1], "likely", _likely_bits(ranges), ranges).items():
            likely[length] = likely[length] | own if length in likely else own
        counting = [k for k in range(1, longest) if k - 1 <= step < k * shards]  # the sums of others are complete; they are not read
        if counting:
            shorter = reduce(DataFrame.unionByName, [s.where(F.col("words").isin(counting)) for s in sums])
            for length, bits in _reached(shorter, likely, enough, BITS, ranges).items():
                table = reached[length]
                entries = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
                new = entries[table[entries] == _NEVER]
                table[new] = step + 1
                if len(new):
                    until = max(until, step + 1 + shards)
        step += 1
    whole = _reached(reduce(DataFrame.unionByName, sums), likely, enough, FINAL_BITS, ranges)
    counted = written(_named(dealt.select("lang", "text"), whole, longest, ranges, all_words), "phrase-counts")
    for path in paths:
        _remove(spark, path)
    return counted


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (left right)), exact while a is below 10^15."""
    exact = lambda c: c.cast("decimal(38,0)")
    million = F.lit(1_000_000).cast("decimal(38,0)")
    return F.call_function("div", million * exact(a) * exact(a), exact(left) * exact(right))


def collocations(df: DataFrame, longest: int = 3, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP, shards: int = SHARDS, **columns) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its weakest cut, n the words of the language.
    """
    counts = _counts(df, longest, least, shards, **columns)
    words = counts.where("words = 0").select("lang", "n")
    frequent = counts.where((F.col("words") > 0) & (F.col("n") >= least))
    candidates = frequent.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(
            k.alias("k"), F.array(F.struct(F.lit("l").alias("side"), k.alias("m"), F.array_join(F.slice("ws", F.lit(1), k), " ").alias("part")), F.struct(F.lit("r").alias("side"), (F.col("words") - k).alias("m"), F.array_join(F.slice("ws", k + 1, F.col("words") - k), " ").alias("part"))).alias("parts")
        ),
    )
    parts = candidates.select("lang", "words", "phrase", "a", F.explode_outer(cuts).alias("cut")).select("lang", "words", "phrase", "a", F.col("cut.k").alias("k"), F.explode_outer("cut.parts").alias("p"))
    copies = F.when(F.col("words") == 1, SALTS[1]).otherwise(SALTS_LONGER)
    asked_copies = F.when(F.col("p.m") == 1, SALTS[1]).otherwise(SALTS_LONGER)
    asked = parts.select("lang", "words", "phrase", "a", "k", "p.side", "p.part", F.pmod(F.crc32(F.col("phrase").cast("binary")), asked_copies).cast("int").alias("salt"))
    known = frequent.where(F.col("words") < longest).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    found = asked.join(known, ["lang", "part", "salt"])
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    both = found.groupBy("lang", "words", "phrase", "a").agg(*[of(k, s).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"])
    scored = F.array(*[F.when(F.col("words") > k, F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)])
    prefix = reduce(lambda c, k: F.when(F.col("words") == k + 1, F.col(f"l{k}")).otherwise(c), range(2, longest), F.lit(None).cast("long"))
    rows = written(both.select("lang", "words", "phrase", "a", F.array_min(scored).alias("best"), prefix.alias("prefix_n"), F.col("r1").alias("suffix_n")), "scored")

    # A phrase inside a longer one is inside one that is a word longer and no rarer than that.
    longer = rows.where("words > 2")
    covers = lambda n: F.col("a") * 100 >= F.col(n) * inside_percent
    inside = longer.where(covers("prefix_n")).select("lang", F.expr("substring_index(phrase, ' ', words - 1) AS phrase")) if longest > 2 else None
    kept = rows
    if inside is not None:
        inside = inside.unionByName(longer.where(covers("suffix_n")).select("lang", F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2) AS phrase")))
        kept = rows.join(inside.distinct(), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    flat = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.crc32(F.col("phrase").cast("binary")), F.lit(64)).alias("part"))
    some = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
