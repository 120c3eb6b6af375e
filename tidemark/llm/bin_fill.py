"""Filling fixed-capacity containers with texts by minimum bin slack.

Texts become items by their number of tokens; one that exceeds the largest capacity is cut into full containers and a
rest. Items are dealt at random to groups of bounded size, and every group is packed on its own: the longest item
left opens the smallest kind of container that holds it, and subset sums over the lengths that are left, kept as the
bits of one integer, find the fullest combination that fits beside it.
"""

from __future__ import annotations

import base64
import functools
import os
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cores, cut, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual splitting pattern of byte-level BPE vocabularies of this size: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PATTERN)
PIECE = T.StructType([T.StructField("doc", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("tokens", T.LongType())])
PLACED = T.StructType([*PIECE.fields, T.StructField("container_kind", T.StringType()), T.StructField("container_id", T.StringType()), T.StructField("capacity", T.LongType())])


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """A byte-level BPE encoding from a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str, step: int = 200_000) -> int:
    """Tokens of a text. Tokens never cross the parts that :data:`PATTERN` splits a text into, so a very long text is
    encoded in steps of whole parts, and the counts add up to that of the text encoded at once."""
    e, n, at = encoding(path), 0, 0
    text = text.encode("utf-8", "replace").decode()
    if len(text) > step:
        for part in SPLIT.finditer(text):
            if part.end() - at >= step:
                n += len(e.encode_ordinary(text[at : part.end()]))
                at = part.end()
    return n + len(e.encode_ordinary(text[at:]))


def fullest(lengths: list[tuple[int, int]], room: int) -> dict[int, int]:
    """How many of each length, of ``(length, how many there are)`` in falling order, fill ``room`` best. Bit s of the
    reach says that sum s can be made; the reach before every step is kept for the way back, and the search ends as
    soon as the room is filled to the last token."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, there in lengths:
        if length > room:
            continue
        left, many = min(there, room // length), 1
        while left > 0:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << length * many) & mask
            left -= many
            many *= 2
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + many
            total -= length * many
    return taken


def pack(items: list[tuple[int, int]], capacities: list[tuple[int, str]]) -> list[tuple[int, str, int]]:
    """Item, kind and bin number for ``(item, length)`` pairs; capacities rise. Items longer than the last capacity
    must have been cut before."""
    by: dict[int, list[int]] = {}
    for item, length in sorted(items, key=lambda x: (x[1], x[0]), reverse=True):
        by.setdefault(length, []).append(item)
    lengths = sorted(by)
    sizes = [c for c, _ in capacities]
    out, bins = [], 0

    def take(length: int, kind: str) -> None:
        out.append((by[length].pop(), kind, bins))
        if not by[length]:
            del by[length]
            lengths.remove(length)

    while lengths:
        longest = lengths[-1]
        capacity, kind = capacities[min(bisect_left(sizes, longest), len(sizes) - 1)]
        take(longest, kind)
        for length, n in fullest([(x, len(by[x])) for x in reversed(lengths)], capacity - longest).items():
            for _ in range(n):
                take(length, kind)
        bins += 1
    return out


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, vocabulary: str) -> DataFrame:
    """``doc, piece, first_token, tokens`` of every text with a token: one row, or as many full pieces as a text beyond
    the capacity has, and its rest."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, t in zip(frame["doc"].tolist(), frame["text"].tolist(), strict=True):
                n = count_tokens(t, vocabulary)
                rows.extend((doc, i, a, min(capacity, n - a)) for i, a in enumerate(range(0, n, capacity)))
            yield pd.DataFrame(rows, columns=PIECE.names)

    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null and text != ''")
    return spread(source).mapInPandas(measure, PIECE)


def fill_containers(docs: DataFrame, containers: DataFrame, *, doc_id: str, text: str, kind: str, capacity: str, vocabulary: str = VOCABULARY, group_items: int = 8000) -> DataFrame:
    """``doc, piece, first_token, tokens, container_kind, container_id, capacity`` for every piece of every text.

    Items are dealt to groups of about ``group_items`` by a hash of their id, whatever their number, so no group grows
    with the input; a group is large enough that little room is lost to its last containers. Only texts longer than
    the largest capacity are divided. Null and empty texts need no room; repeated rows are items of their own;
    container kinds with a null or no capacity are left out, and without any kind there is no result."""
    kinds = sorted((int(r[1]), str(r[0])) for r in containers.select(kind, capacity).distinct().collect() if r[1] and int(r[1]) > 0 and r[0] is not None)
    if not kinds:
        return docs.sparkSession.createDataFrame([], PLACED)
    items = cut(pieces(docs, doc_id, text, kinds[-1][0], vocabulary))
    groups = max(1, -(-items.count() // group_items))
    names = dict((k, c) for c, k in kinds)

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc", "piece"]).reset_index(drop=True)
        rows = pack(list(enumerate(frame["tokens"].tolist())), kinds)
        at = pd.DataFrame(rows, columns=["i", "container_kind", "bin"]).set_index("i").sort_index()
        frame["container_kind"] = at["container_kind"]
        frame["container_id"] = frame["g"].astype(str) + "-" + at["bin"].astype(str)
        frame["capacity"] = at["container_kind"].map(names)
        return frame[PLACED.names]

    # a stated number of partitions, which AQE doesn't merge by their few bytes: the work is in the packing
    dealt = items.withColumn("g", F.pmod(F.xxhash64("doc", "piece"), F.lit(groups)).cast("int")).repartition(min(groups, 16 * cores(docs.sparkSession)), "g")
    return dealt.groupBy("g").applyInPandas(packed, PLACED)


def container_use(placed: DataFrame) -> DataFrame:
    """``container_kind, containers, tokens, unused`` by kind."""
    each = placed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("c"))
    return each.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.sum(F.col("c") - F.col("t")).alias("unused"))
