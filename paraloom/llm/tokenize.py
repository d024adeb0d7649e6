"""Problem 8: the whole corpus as token ids of a public byte-level BPE vocabulary.

Every text is cut into overlapping chunks of ``CHUNK`` characters, each chunk is
cut into pre-tokens on its own, and two neighbours are stitched at a boundary
that both of them found: pre-tokenising looks forward only, so from a common
boundary on both agree.  Only boundaries that stand there wherever a chunk
begins are taken (the end of a run of letters or figures, or of anything before
white space), so a chunk may be stitched to the next before its own beginning is
known.  Where an overlap holds none, the piece before goes on until the next
stitch, so a run longer than chunks costs no more than itself.  The pre-tokens
between two stitches are then encoded.  Texts over ``SPREAD`` characters have
their chunks in rows of their own, so that many tasks share one text; how they
are cut and stitched is the same.  Decoding concatenates the raw bytes.

Defined results: empty and null texts both give the empty list; strings that
look like special tokens are ordinary text; repeated rows are each encoded.
The vocabulary's folder is a parameter and its files are read where the task
runs, never copied.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraloom.session import materialize

VOCABULARIES = "/opt/tokenizers"
# fixed value: the published pre-tokeniser pattern of this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SPLIT = regex.compile(PATTERN)
# ends of pre-tokens whatever stands before the run that ends there
FIRM = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")
CHUNK, OVERLAP = 2048, 128
SPREAD = 1 << 20
LOOKAHEAD = 3  # characters the pattern may look at beyond the end of a match
CACHE = 400_000

_loaded: dict[str, tuple[tiktoken.Encoding, dict[str, list[int]]]] = {}


def ranks(name: str, folder: str = VOCABULARIES) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encoder(name: str, folder: str = VOCABULARIES):
    """(tiktoken encoding, cache of pre-token ids), once per process."""
    key = f"{folder}/{name}"
    if key not in _loaded:
        _loaded[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={}), {}
    return _loaded[key]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens; together they are the text."""
    return SPLIT.findall(text)


def boundaries(text: str, start: int = 0, end: int | None = None) -> list[int]:
    """Ends of the pre-tokens of ``text[start:end]``, as places of the text."""
    return list(accumulate(map(len, SPLIT.findall(text[start:end])), initial=start))[1:]


def meeting(ends: list[int], before: list[int], start: int, stop: int, text: str) -> int | None:
    """The first firm boundary in (start, stop] that both chunks found."""
    known = set(before[bisect_left(before, start + 1):bisect_left(before, stop + 1)])
    return next((e for e in ends[:bisect_left(ends, stop + 1)] if e in known and FIRM.match(text, e)), None)


def stitched(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of a text in pieces, found from overlapping chunks."""
    n, at, end = len(text), 0, min(len(text), chunk + overlap)
    pieces = SPLIT.findall(text[:end])
    ends = list(accumulate(map(len, pieces)))
    while end < n:
        start = end - overlap
        stop = min(n, end + chunk)
        following = SPLIT.findall(text[start:stop])
        following_ends = list(accumulate(map(len, following), initial=start))[1:]
        met = meeting(following_ends, ends, start, end - LOOKAHEAD, text)
        if met is not None:
            yield pieces[:bisect_left(ends, met) + 1]
            first = bisect_left(following_ends, met) + 1
            pieces, ends, at = following[first:], following_ends[first:], met
        else:  # the piece goes on from its last sure boundary, over twice as much where it has none
            sure = bisect_left(ends, end - LOOKAHEAD + 1)
            yield pieces[:sure]
            at = ends[sure - 1] if sure else at
            stop = min(n, end + max(chunk, end - at))
            pieces = SPLIT.findall(text[at:stop])
            ends = list(accumulate(map(len, pieces), initial=at))[1:]
        end = stop
    yield pieces


def encode_piece(text: str, encoding: tiktoken.Encoding, cache: dict[str, list[int]], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    ids: list[int] = []
    add = ids.extend
    get = cache.get
    for pieces in stitched(text, chunk, overlap):
        for piece in pieces:
            found = get(piece)
            if found is None:
                found = encoding._encode_single_piece(piece) if len(piece) < 64 else encoding.encode_ordinary(piece)
                if len(cache) < CACHE and len(piece) < 64:
                    cache[piece] = found
            add(found)
    return ids


def _encode(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, cache = encoder(name, folder)
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if text:
                    flat += encode_piece(text, encoding, cache)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a chunk and the one before it meet first, or null; ``chunk`` holds both, from ``lead`` characters earlier."""
    for batch in batches:
        met = []
        for start, lead, text in zip(*(batch.column(c).to_pylist() for c in ("start", "lead", "chunk"))):
            reach = min(len(text), lead + OVERLAP)
            m = meeting(boundaries(text, lead), boundaries(text, 0, reach), lead, reach - LOOKAHEAD, text)
            met.append(None if m is None else start - lead + m)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(met, pa.int64())], names=["row", "met"])


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES,
                  spread: int = SPREAD) -> DataFrame:
    """(key, ids): the token ids of every row's text."""
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = source.schema["key"].dataType.simpleString()
    long = F.coalesce(F.length("text") > spread, F.lit(False))
    within = source.where(~long).mapInArrow(_encode(name, folder), f"key {key_type}, ids array<int>")
    # the few long ones are set down with a row number first: it must be the same wherever it is read again
    rows = materialize(source.where(long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    return within.unionByName(_encode_spread(rows, key_type, name, folder, spread)).select(F.col("key").alias(key), "ids")


def _encode_spread(rows: DataFrame, key_type: str, name: str, folder: str, own: int) -> DataFrame:
    """Texts over several tasks: stitches of ``own`` characters each found in parallel, the pieces encoded in parallel, gathered per text."""
    n = F.length("text")
    cut = rows.select("row", "text", F.explode(F.sequence(F.lit(own), (n - 1).cast("int"), F.lit(own))).alias("start"))
    lead = F.least("start", F.lit(CHUNK))
    chunks = cut.select("row", F.col("start").cast("bigint").alias("start"), lead.alias("lead"),
                        F.substring("text", F.col("start") - lead + 1, lead + F.lit(OVERLAP + CHUNK)).alias("chunk"))
    met = chunks.mapInArrow(_meetings, "row bigint, met bigint").where("met is not null")
    starts = rows.select("row", F.lit(0).cast("bigint").alias("met")).unionByName(met)
    until = starts.withColumn("until", F.lead("met").over(Window.partitionBy("row").orderBy("met")))
    pieces = rows.join(until, "row").select(
        "row", "key", F.col("met").alias("piece"), F.expr("substring(text, cast(met as int) + 1, cast(coalesce(until, length(text)) - met as int))").alias("text"))
    encoded = pieces.repartition("row", "piece").mapInArrow(_encode(name, folder), f"row bigint, key {key_type}, piece bigint, ids array<int>")
    gathered = encoded.groupBy("row", "key").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    return gathered.select("key", F.flatten("parts.ids").alias("ids"))


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> str:
    """Concatenate the bytes of the ids; exact for every text that was encoded."""
    encoding, _ = encoder(name, folder)
    return b"".join(encoding.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = encoder(name, folder)
        for batch in batches:
            texts = [encoding.decode_bytes(x or []).decode("utf-8", errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def token_count(ids: Column) -> Column:
    return F.size(ids)
