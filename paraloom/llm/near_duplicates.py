"""Problem 5: texts that share most of their word n-grams.

A set-similarity join by vertical partitioning.  All n-grams stand in one
global order, the rare ones first; each text keeps the head of its own list
that two similar texts must share (``EXTRA`` of them, not only one); the order
is cut into fragments, each fragment counts the overlaps of its own n-grams
pair by pair, and the partial counts are summed per pair.  Pairs that reach the
number that similar texts must reach are then compared on all their n-grams.

An n-gram that is rare among few texts is held by many among more, so the pairs
that meet in it grow with the square of the texts.  Every entry therefore has a
sketch of its whole text: bit k tells whether an odd number of the text's
n-grams fall to k.  Two sketches differ in no more bits than the two sets differ
in n-grams, so a pair whose sketches differ in more than similar texts may is
none, and only what is left is written and summed.  The heads are set down once
and meet in passes, a share of the fragments at a time.

No pair is lost: the order only has to be the same everywhere.  It is taken
from a hashed table of the n-gram counts of the whole collection, whose size is
fixed.  A match counts for a pair only within the heads that these two sizes
need, which is far less than the heads any partner could need.  The fragments
grow in number with the collection and not in size; an n-gram that very many
texts hold is cut further, into pairs of blocks of its texts.  Equal texts are
one class from the start, so a group of copies is joined once however large it
is; results give classes and members, and only ``expand_pairs`` writes out pairs
of rows, large classes in blocks.  Different texts with one hash are told apart.

Defined results: null texts and texts under the minimum of words are in no
pair and form classes of their own; repeated rows are members of one class;
texts of any length are compared whole.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraloom.llm.words import WORD
from paraloom.session import discard, materialize

COUNT_BITS = 22  # buckets of the n-gram counts: a fixed four megabytes of one-byte logarithms
COUNT_PARTS = 64
EXTRA = 4
SKETCH_BITS = 256
ENTRY = np.dtype([("gram", "<u4"), ("size", "<u2"), ("place", "<u2"), ("text", "<i8"), ("sketch", "<u8", (SKETCH_BITS // 64,))])
ENTRIES_PER_PASS, MOST_PASSES = 2_500_000, 8  # of the fragments that are on disk at a time
LONG = 65535  # sizes from here on are not told apart: such texts meet all partners
HASH_BITS = 50  # of an n-gram in the global order; those that meet by chance are told apart when pairs are compared
ENTRIES_PER_FRAGMENT = 100_000
TASK_BYTES, MOST_TASKS = 4 << 20, 20_000  # of the fragments a task reads
CROWD = 1 << 14  # texts of one n-gram from which they are cut into blocks
FLUSH_ENTRIES = 600_000
FLUSH_GRAMS = 6_000_000
FLUSH_PAIRS = 3_000_000
BLOCK = 1 << 19  # pairs looked at together
FILTER_BITS, MOST_FILTER_BITS = 12, 1 << 27  # for each id; beyond that a join does it
CLASS_BLOCK, HOT_CLASSES = 20_000, 1_000  # rows of a class that are one block at least; at most so many classes are cut
MOST_CLASHES = 10_000
WORDS_KEPT = 400_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Words:
    """Word hashes of a task; the table is dropped when it has grown large."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.hashes: list[int] = []

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word of every text, words of each text)."""
        if len(self.ids) > WORDS_KEPT:
            self.ids, self.hashes = {}, []
        ids, hashes, flat, lengths = self.ids, self.hashes, [], []
        for text in texts:
            words = WORD.findall(text.lower()) if text else ()
            lengths.append(len(words))
            for w in words:
                i = ids.get(w)
                if i is None:
                    i = ids[w] = len(hashes)
                    hashes.append(xxhash.xxh3_64_intdigest(w))
                flat.append(i)
        return np.array(hashes, np.uint64)[np.array(flat, np.int64)] if flat else np.zeros(0, np.uint64), np.array(lengths, np.int64)


def _raw_grams(hashes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit n-gram) at every place where one begins."""
    last = len(hashes) - width + 1
    if last <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = text[:last] == text[width - 1:]
    gram = np.zeros(last, np.uint64)
    for k in range(width):
        gram = (gram ^ (hashes[k:k + last] * _MIX[k % 5])) * _MIX[(k + 1) % 5]
        gram ^= gram >> np.uint64(29)
    return text[:last][inside], gram[inside]


def _count_grams(width: int):
    """Counts of the task's n-grams by bucket, in compressed parts of the bucket range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n, total = _Words(), [], 0, np.zeros(1 << COUNT_BITS, np.int64)

        def add():
            np.add(total, np.bincount(np.concatenate(held), minlength=len(total)), out=total)

        for batch in batches:
            _, gram = _raw_grams(*words.of(batch.column(0).to_pylist()), width)
            held.append((gram >> np.uint64(64 - COUNT_BITS)).astype(np.int32))
            n += len(gram)
            if n > FLUSH_GRAMS:
                add()
                held, n = [], 0
        if n:
            add()
        if total.any():
            parts = [zlib.compress(p.astype(np.uint32).tobytes(), 1) for p in np.split(total, COUNT_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    return run


def _sum_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, part = np.zeros((1 << COUNT_BITS) // COUNT_PARTS, np.int64), None
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            total += np.frombuffer(zlib.decompress(blob), np.uint32)
    coarse = np.round(8 * np.log2(np.maximum(total, 1))).clip(0, 255).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([coarse.tobytes()], pa.binary()), pa.array([int(total.sum())])],
                                     names=["part", "coarse", "n"])


def gram_rarity(df: DataFrame, width: int, text: str = "text") -> tuple[np.ndarray, int]:
    """(coarse logarithm of the count of every bucket, all n-grams); what reaches the driver has a fixed size."""
    parts = df.select(text).mapInArrow(_count_grams(width), "part int, counts binary")
    got = parts.groupBy("part").applyInArrow(_sum_part, "part int, coarse binary, n bigint").toArrow().to_pylist()
    rarity = np.zeros((COUNT_PARTS, (1 << COUNT_BITS) // COUNT_PARTS), np.uint8)
    for row in got:
        rarity[row["part"]] = np.frombuffer(row["coarse"], np.uint8)
    return rarity.ravel(), sum(row["n"] for row in got)


def ordered_grams(hashes: np.ndarray, lengths: np.ndarray, width: int, rarity: np.ndarray | None):
    """(text index, n-gram) without repeats, sorted by both; with ``rarity`` in the global order, rarest first."""
    text, key = _raw_grams(hashes, lengths, width)
    if rarity is not None:
        common = rarity[(key >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
        key = (common.astype(np.uint64) << np.uint64(50)) | (key >> np.uint64(14))
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return text[fresh], key[fresh]


def _packed(entries: np.ndarray) -> bytes:
    """Entries in order of their n-grams, byte by byte, so that they compress."""
    entries = entries[np.argsort(entries["gram"], kind="stable")]
    return zstandard.compress(np.ascontiguousarray(entries.view(np.uint8).reshape(-1, ENTRY.itemsize).T).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(ENTRY.itemsize, -1).T).view(ENTRY).ravel()


def _in_blocks(entry: np.ndarray, gram: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, entry) of the entries of crowded n-grams: each with every block of its n-gram's texts.

    These fragments are negative; in the even ones all texts meet, in the odd
    ones those of two blocks, told apart by the last bit of ``gram``.
    """
    own = (entry["text"].view(np.uint64) * _MIX[2] >> np.uint64(33)).astype(np.int64) % blocks
    at = np.repeat(np.arange(len(entry)), blocks)
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own, key = own[at], gram[at] * _MIX[0]
    low, high = np.minimum(own, other), np.maximum(own, other)
    for x in (low, high):
        key = (key ^ x.astype(np.uint64)) * _MIX[1]
        key ^= key >> np.uint64(31)
    fragment = -(((key >> np.uint64(3)) << np.uint64(1)).astype(np.int64) + 2 + (low != high))
    out = entry[at]
    out["gram"] = (gram[at] & np.uint64((1 << 31) - 1)).astype(np.uint32) << 1 | ((low != high) & (own == high))
    return fragment, out


def _sketches(text: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts, which of ``SKETCH_BITS`` an odd number of its n-grams fall to."""
    bit = (key * _MIX[3] >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    odd = np.bincount(text * SKETCH_BITS + bit, minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(n, SKETCH_BITS), axis=1)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _heads(rarity: np.ndarray, width: int, least: float, min_words: int):
    """The texts' heads: size, sketch, and the n-grams of the head in the global order, as bands of rarity and hashes of seven bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        for batch in batches:
            classes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, c in enumerate(classes):  # a copy adds nothing
                if c in seen:
                    texts[i] = None
                seen.add(c)
            if len(seen) > 1_000_000:
                seen.clear()
            hashes, lengths = words.of(texts)
            short = lengths < min_words
            if short.any():
                hashes, lengths = hashes[np.repeat(~short, lengths)], np.where(short, 0, lengths)
            text, key = ordered_grams(hashes, lengths, width, rarity)
            if not len(key):
                continue
            full, text = np.unique(text, return_inverse=True)
            size = np.bincount(text)
            first = np.cumsum(size) - size
            sketch = _sketches(text, key, len(full))
            head = np.minimum(size - np.ceil(least * size - 1e-9).astype(np.int64) + EXTRA, size)
            key = key[np.arange(len(key)) - first[text] < head[text]]
            ends = np.cumsum(head)
            gram = (key & np.uint64((1 << HASH_BITS) - 1)).view(np.uint8).reshape(-1, 8)[:, :7]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(classes, np.int64)[full]), pa.array(size.astype(np.int32)), _binary(sketch, np.arange(1, len(full) + 1) * sketch.shape[1]),
                 _binary((key >> np.uint64(HASH_BITS)).astype(np.uint8), ends), _binary(gram, ends * 7)], names=["id", "size", "sketch", "bands", "grams"])

    return run


def _entries(turn: int, turns: int, bits: int, crowd: float):
    """Entries of the heads, packed by fragment of the global order, which is cut into 2^bits ranges of every band; those fragments whose turn it is.

    ``crowd``: occurrences of a bucket of n-grams from which their texts are cut into blocks.
    """
    low_bits = HASH_BITS - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_fragments, n_held = [], [], 0

        def pack():
            fragment, entries = np.concatenate(held_fragments), np.concatenate(held)
            order = np.argsort(fragment, kind="stable")
            fragment, entries = fragment[order], entries[order]
            cut = np.flatnonzero(np.diff(fragment)) + 1
            start = np.concatenate([[0], cut])
            blobs = [_packed(x) for x in np.split(entries, cut)]
            return pa.RecordBatch.from_arrays([pa.array(fragment[start]), pa.array(blobs, pa.binary())], names=["fragment", "entries"])

        def mine(fragment: np.ndarray) -> np.ndarray:
            return (fragment.view(np.uint64) * _MIX[4] >> np.uint64(33)) % np.uint64(turns) == turn

        for batch in batches:
            ids, size = batch.column("id").to_numpy(), batch.column("size").to_numpy().astype(np.int64)
            bands = batch.column("bands").to_pylist()
            head = np.array([len(b) for b in bands], np.int64)
            common = np.frombuffer(b"".join(bands), np.uint8).astype(np.int64)
            gram = np.zeros((len(common), 8), np.uint8)
            gram[:, :7] = np.frombuffer(b"".join(batch.column("grams").to_pylist()), np.uint8).reshape(-1, 7)
            gram = gram.view(np.uint64).ravel()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
            text = np.repeat(np.arange(len(ids)), head)
            place = np.arange(len(text)) - np.repeat(np.cumsum(head) - head, head)
            fragment = common // 16 << 32 | (gram >> np.uint64(low_bits)).astype(np.int64)
            blocks = np.ceil(2 ** (common / 8) / crowd).astype(np.int64)

            def entries(at: np.ndarray) -> np.ndarray:
                entry = np.empty(len(at), ENTRY)
                entry["gram"] = (gram[at] & np.uint64((1 << low_bits) - 1)) >> np.uint64(max(0, low_bits - 32))
                entry["size"] = np.minimum(size, LONG)[text[at]]
                entry["place"] = np.minimum(place, LONG)[at]
                entry["text"] = ids[text[at]]
                entry["sketch"] = sketch[text[at]]
                return entry

            plain = np.flatnonzero((blocks <= 1) & mine(fragment))
            held.append(entries(plain))
            held_fragments.append(fragment[plain])
            crowded = np.flatnonzero(blocks > 1)
            if len(crowded):
                more, cut = _in_blocks(entries(crowded), gram[crowded], blocks[crowded])
                now = mine(more)
                held.append(cut[now])
                held_fragments.append(more[now])
            n_held += sum(map(len, held[-2:] if len(crowded) else held[-1:]))
            if n_held >= FLUSH_ENTRIES:
                yield pack()
                held, held_fragments, n_held = [], [], 0
        if n_held:
            yield pack()

    return run


def _pair_batch(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(left, right), np.maximum(left, right)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(fresh)
    n = np.diff(np.append(at, len(low)))
    return pa.RecordBatch.from_arrays([pa.array(low[at]), pa.array(high[at]), pa.array(n.astype(np.int32))], names=["a", "b", "overlap"])


def _fragment_pairs(least: float):
    """Partial overlaps of one fragment, pair by pair."""
    share = least / (1 + least)

    def near(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How often a match counts: 0 outside the heads these two texts need, and where the sketches differ too much.

        Two texts too short to share EXTRA n-grams count each shared one so often.
        """
        x, y = e["size"][i].astype(np.int64), e["size"][j].astype(np.int64)
        need = np.ceil(share * (x + y) - 1e-9).astype(np.int64)
        often = np.where(need < EXTRA, EXTRA, 1)
        inside = (need <= np.minimum(x, y)) & (e["place"][i] < x - need + EXTRA) & (e["place"][j] < y - need + EXTRA)
        at = np.flatnonzero(inside)
        differ = np.bitwise_count(e["sketch"][i[at]] ^ e["sketch"][j[at]]).sum(axis=1, dtype=np.int64)
        inside[at] = differ <= x[at] + y[at] - 2 * need[at]
        return np.where(inside | (x == LONG) | (y == LONG), often, 0)

    def run(blobs: list[bytes], fragment: int) -> Iterator[pa.RecordBatch]:
        e = np.concatenate([_unpacked(b) for b in blobs])
        e = e[np.lexsort((e["text"], e["gram"]))]
        fresh = np.ones(len(e), bool)  # copies read by several tasks
        fresh[1:] = (e["gram"][1:] != e["gram"][:-1]) | (e["text"][1:] != e["text"][:-1])
        e = e[fresh]
        sides = fragment < 0 and fragment % 2 == 1
        gram = (e["gram"] >> 1 if sides else e["gram"]).astype(np.int64)
        order = np.lexsort((e["text"], e["size"], gram))
        e, gram = e[order], gram[order]
        # each entry against those of its n-gram that are no smaller, up to the size its place allows; sizes of LONG are not told apart
        x = e["size"].astype(np.int64)
        most = np.floor(np.minimum(x + EXTRA - 1 - e["place"].astype(np.int64), x) / share - x + 1e-6).astype(np.int64)
        most = np.where(x == LONG, LONG, np.clip(most, 0, LONG))
        own = np.arange(len(e))
        n = np.maximum(np.searchsorted(gram << 16 | x, gram << 16 | most, "right") - own - 1, 0)
        upto = np.concatenate([[0], np.cumsum(n)])
        left, right, held, begin = [], [], 0, 0
        while begin < len(e):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + BLOCK, "right")) - 1)
            i = np.repeat(own[begin:end], n[begin:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[begin:end] - upto[begin], n[begin:end])
            begin = end
            if sides:  # those of one block meet elsewhere
                other = e["gram"][i] != e["gram"][j]
                i, j = i[other], j[other]
            often = near(e, i, j)
            left.append(np.repeat(e["text"][i], often))
            right.append(np.repeat(e["text"][j], often))
            held += len(left[-1])
            if held > FLUSH_PAIRS:
                yield _pair_batch(np.concatenate(left), np.concatenate(right))
                left, right, held = [], [], 0
        if held:
            yield _pair_batch(np.concatenate(left), np.concatenate(right))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, fragment = [], 0
        for batch in batches:
            blobs += batch.column("entries").to_pylist()
            fragment = batch.column("fragment")[0].as_py()
        yield from run(blobs, fragment)

    return call


def _filter_positions(x: np.ndarray, bits: int) -> np.ndarray:
    u = x.astype(np.int64).view(np.uint64)
    step = (u * _MIX[0] >> np.uint64(17)) | np.uint64(1)
    return np.stack([(u + step * np.uint64(k)) & np.uint64(bits - 1) for k in range(4)])


def _filter(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter for ``n`` ids of the column ``id``, ``FILTER_BITS`` bits for each."""
    bits = 1 << max(16, math.ceil(math.log2(max(n, 1) * FILTER_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for p in _filter_positions(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(held, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at].view(np.int64))], names=["word", "bits"])

    got = ids.mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return held


def _full_grams(held: np.ndarray | None, width: int):
    """All n-grams of the texts that the filter (if any) lets through, once per class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        for batch in batches:
            classes = batch.column(0).to_numpy()
            inside = np.ones(len(classes), bool)
            for p in _filter_positions(classes, 64 * len(held)) if held is not None else ():
                inside &= (held[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            pick = [i for i in np.flatnonzero(inside) if classes[i] not in seen]
            if len(seen) < 1_000_000:
                seen.update(classes[pick].tolist())
            if not pick:
                continue
            texts = batch.column(1).take(pa.array(pick)).to_pylist()
            hashes, lengths = words.of(texts)
            text, gram = ordered_grams(hashes, lengths, width, None)
            parts = np.split(gram, np.cumsum(np.bincount(text, minlength=len(pick)))[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes[pick]), pa.array(lengths, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "words", "grams"])

    return run


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                score.append(both / max(len(a) + len(b) - both, 1))
            keep = pa.array([s >= least - 1e-12 for s in score])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    return run


class Similar(NamedTuple):
    links: DataFrame  # a, b, similarity with a < b
    compared: DataFrame  # id: the classes that were compared or copied and have the words for it
    copies: DataFrame  # class, n: texts that occur more than once
    clashing: tuple[int, ...]  # hashes that several texts share


def class_of(text: Column, clashing: tuple[int, ...] = ()) -> Column:
    """The class of a text: its hash, and a second one where different texts share the first."""
    first = F.xxhash64(text)
    return F.when(first.isin(*clashing), F.xxhash64(text, F.lit(2))).otherwise(first) if clashing else first


def _copies(df: DataFrame, text: str) -> tuple[DataFrame, tuple[int, ...]]:
    """(class, n) of the texts that occur more than once, and the hashes that different texts share."""
    def counted(clashing):
        rows = df.where(F.col(text).isNotNull()).select(class_of(F.col(text), clashing).alias("class"), F.xxhash64(F.col(text), F.lit(1)).alias("check"))
        return materialize(rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), (F.min("check") != F.max("check")).alias("clash")).where("n > 1"), "copies", drop_shuffles=True)

    copies = counted(())
    clashing = tuple(sorted(r["class"] for r in copies.where("clash").select("class").limit(MOST_CLASHES + 1).collect()))
    if len(clashing) > MOST_CLASHES:  # some hundred are expected among 10^11 texts
        raise ValueError("texts made to share their hashes")
    if clashing:
        copies = counted(clashing)
    return copies.select("class", "n"), clashing


def similar_classes(df: DataFrame, text: str = "text", width: int = 5, least: float = 0.8, min_words: int = 1) -> Similar:
    """The classes of equal texts, and links between those whose n-gram sets have a Jaccard similarity of ``least`` or more."""
    copies, clashing = _copies(df, text)
    source = df.where(F.col(text).isNotNull()).select(class_of(F.col(text), clashing).alias("class"), F.col(text).alias("text"))
    rarity, n_grams = gram_rarity(source, width)
    entries = n_grams * (1 - least)
    bits = max(3, min(HASH_BITS - 18, math.ceil(math.log2(max(entries / ENTRIES_PER_FRAGMENT, 1)))))
    heads = materialize(source.mapInArrow(_heads(rarity, width, least, min_words), "id bigint, size int, sketch binary, bands binary, grams binary"), "heads")
    turns = max(1, min(MOST_PASSES, math.ceil(entries / ENTRIES_PER_PASS)))
    tasks = max(1, min(MOST_TASKS, math.ceil(entries * ENTRY.itemsize / turns / TASK_BYTES)))
    met = []
    for turn in range(turns):
        packed = heads.mapInArrow(_entries(turn, turns, bits, CROWD + n_grams / (1 << COUNT_BITS)), "fragment bigint, entries binary")
        partial = packed.repartition(tasks, "fragment").groupBy("fragment").applyInArrow(_fragment_pairs(least), "a bigint, b bigint, overlap int")
        met.append(materialize(partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap")), "partial-overlaps", drop_shuffles=True))
    summed = functools.reduce(DataFrame.unionByName, met).groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    candidates = materialize(summed.where(F.col("overlap") >= EXTRA).select("a", "b"), "candidate-pairs", drop_shuffles=True)
    discard(heads, *met)
    ids = candidates.select(F.explode(F.array("a", "b")).alias("id")).unionByName(copies.select(F.col("class").alias("id")))
    n_ids = ids.count()
    if n_ids * FILTER_BITS <= MOST_FILTER_BITS:
        grams = source.mapInArrow(_full_grams(_filter(ids, n_ids), width), "id bigint, words int, grams binary")
    else:
        grams = source.join(ids.distinct(), F.col("class") == F.col("id"), "left_semi").mapInArrow(_full_grams(None, width), "id bigint, words int, grams binary")
    once = materialize(grams.where(F.col("words") >= min_words).dropDuplicates(["id"]), "class-grams", drop_shuffles=True)
    both = (
        candidates.join(once.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
        .join(once.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")
    )
    links = materialize(both.mapInArrow(_compare(least), "a bigint, b bigint, similarity double"), "links", drop_shuffles=True)
    return Similar(links, once.select("id"), copies, clashing)


def expand_pairs(df: DataFrame, similar: Similar, key: str = "para_id", text: str = "text") -> DataFrame:
    """(key_a, key_b) with key_a < key_b: rows of linked classes, and rows of one class.

    As many rows as there are such pairs, so only for a result that asks for them;
    rows without a key are in none.
    Classes with more rows than a thousandth of all (and ``CLASS_BLOCK``) are cut
    into blocks, and their pairs into pairs of blocks.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), class_of(F.col(text), similar.clashing).alias("class"))
    block = max(CLASS_BLOCK, -(-df.count() // HOT_CLASSES))
    # at most HOT_CLASSES classes are that large
    hot = similar.copies.where(F.col("n") > block).select("class", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    last = lambda c: F.coalesce(F.col(c) - 1, F.lit(0))
    members = rows.join(F.broadcast(hot), "class", "left").select("key", "class", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    of = lambda side: F.broadcast(hot.select(F.col("class").alias(side), F.col("blocks").alias(f"{side}_blocks")))
    linked = similar.links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    linked = linked.withColumn("i", F.explode(F.sequence(F.lit(0), last("a_blocks")))).withColumn("j", F.explode(F.sequence(F.lit(0), last("b_blocks"))))
    own = similar.copies.join(similar.compared, F.col("class") == F.col("id"), "left_semi").select(F.col("class").alias("a")).join(of("a"), "a", "left")
    own = own.withColumn("i", F.explode(F.sequence(F.lit(0), last("a_blocks")))).withColumn("j", F.explode(F.sequence(F.col("i"), last("a_blocks"))))
    every = linked.select("a", "i", "b", "j").unionByName(own.select("a", "i", F.col("a").alias("b"), "j"))
    first = members.select(F.col("key").alias("k1"), F.col("class").alias("a"), F.col("block").alias("i"))
    second = members.select(F.col("key").alias("k2"), F.col("class").alias("b"), F.col("block").alias("j"))
    met = every.join(first, ["a", "i"]).join(second, ["b", "j"]).where((F.col("a") != F.col("b")) | (F.col("i") != F.col("j")) | (F.col("k1") < F.col("k2")))
    return met.select(F.least("k1", "k2").alias(f"{key}_a"), F.greatest("k1", "k2").alias(f"{key}_b"))


def components(links: DataFrame) -> DataFrame:
    """(id, root): the connected component of every linked id, named by its smallest id.

    Labels flow along links and are then shortened (label of the label), so the
    rounds grow with the logarithm of a component's width; every round is a
    table in the shared folder and nothing but one count reaches the driver.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(near, F.col("id") == F.col("a"), "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        jump = labels.select(F.col("id").alias("at"), F.col("root").alias("jump"))
        after = materialize(
            nearer.join(jump, F.col("next") == F.col("at"), "left")
            .select("id", F.col("root").alias("was"), F.least("next", F.coalesce("jump", "next")).alias("root")), "labels")
        moved = after.where("was <> root").limit(1).count()
        labels = after.select("id", "root")
        if not moved:
            return labels


def groups(df: DataFrame, similar: Similar, key: str = "para_id", text: str = "text") -> DataFrame:
    """(key, class, group, n_links): one row per row.

    ``class`` is the smallest key of the rows of that text, ``group`` that of its
    component, ``n_links`` the number of other classes it is linked with.  Rows
    without a text are by themselves.
    """
    members = df.select(F.col(key).alias("key"), F.when(F.col(text).isNotNull(), class_of(F.col(text), similar.clashing)).alias("hash"))
    degree = similar.links.select(F.explode(F.array("a", "b")).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(similar.links).select(F.col("id").alias("hash"), "root")
    # copies and linked texts are few beside all rows: only they are looked up
    first = members.join(similar.copies.select(F.col("class").alias("hash")).unionByName(roots.select("hash")).distinct(), "hash", "left_semi").groupBy("hash").agg(F.min("key").alias("first"))
    of_root = roots.join(first, "hash").groupBy("root").agg(F.min("first").alias("group"))
    known = first.join(roots, "hash", "left").join(of_root, "root", "left").join(degree, "hash", "left").select("hash", "first", "group", "n_links")
    known = materialize(known, "classes")
    return members.join(known, "hash", "left").select(
        F.col("key").alias(key), F.coalesce("first", "key").alias("class"), F.coalesce("group", "first", "key").alias("group"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
