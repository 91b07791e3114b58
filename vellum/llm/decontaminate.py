"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of an item.  Both sides keep, of every
window, the smallest of its GRAM-word hashes.  Equal windows keep equal hashes,
so each shared span of WINDOW words or more shows up as a shared fingerprint;
such hits are extended to the whole window and checked on all of its words.
Items with fewer words are one window of their own length, fingerprinted whole.

The test side is measured first and indexed in blocks of at most BLOCK_BYTES of
item text; fingerprints meet in a join whose test side is broadcast, a block at a
time.  One block: documents are read once and never move.  More blocks: each has a
pass of its own over the texts, which writes the hits of the texts that have any and
then gives its memory back; at the end the hits of all blocks come together by text
and join the documents, so workers hold one block whatever the test side's size.

Defined cases: a null or wordless document has no words and no hits; a null or
wordless item has no windows; repeated rows each get their own result; items
that share an id count once; a null item id is written as the empty string.
Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, prepare, text_of
from .kernels import ALNUM, U64, Words, gram_at, grams, slices

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 32 << 20


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The kept hash of every window of WINDOW words."""
    return _window_minimum(grams(hashes, GRAM), WINDOW - GRAM + 1) if len(hashes) >= WINDOW else np.empty(0, U64)


class _Postings:
    """Window hash -> item numbers, as sorted arrays."""

    def __init__(self, keys: list[np.ndarray], items: list[np.ndarray]):
        k, v = np.concatenate(keys), np.concatenate(items)
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        k, v = k[new], v[new]
        self.keys, first = np.unique(k, return_index=True)
        self.bounds, self.items = np.append(first, len(k)), v

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash among the keys, or -1."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


class Index:
    """Fingerprints and windows of one block of items."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids = ids
        keys: dict[int, list] = {}
        items: dict[int, list] = {}
        kept = []
        words = [Words(body, offsets, ALNUM) for _, _, body, offsets in slices(pa.array(texts, pa.large_string()))] if texts else []
        number = 0
        for part in words:
            hashes = part.hashes()
            for i in range(len(part.counts)):
                own = hashes[part.rows[i] : part.rows[i + 1]]
                n = min(len(own), WINDOW)
                if n:
                    found = grams(own, n)
                    keys.setdefault(n, []).append(found)
                    items.setdefault(n, []).append(np.full(len(found), number, np.int32))
                    kept.append(_fingerprints(own))
                number += 1
        self.fingerprints = np.unique(np.concatenate(kept)) if kept else np.empty(0, U64)
        self.windows = {n: _Postings(keys[n], items[n]) for n in keys}

    def scan(self, words: Words):
        """(row, first word, length, key number) of every occurring window of the slice, in four arrays."""
        hashes, row = words.hashes(), words.row_of_word()
        out = []
        for length, postings in self.windows.items():
            n = len(hashes) - length + 1
            if n <= 0:
                continue
            whole = row[:n] == row[length - 1 :]
            if length == WINDOW:
                if not len(self.fingerprints):
                    continue
                kept = _fingerprints(hashes)
                change = np.flatnonzero(np.append(True, kept[1:] != kept[:-1]))  # a kept hash serves a run of windows
                at = np.minimum(np.searchsorted(self.fingerprints, kept[change]), len(self.fingerprints) - 1)
                hit = self.fingerprints[at] == kept[change]
                starts = np.flatnonzero(np.repeat(hit, np.diff(np.append(change, n))) & whole)
                key = postings.find(gram_at(hashes, starts, length)) if len(starts) else np.empty(0, np.int64)
            else:
                starts = np.flatnonzero(whole)
                key = postings.find(grams(hashes, length)[starts]) if len(starts) else np.empty(0, np.int64)
            good = key >= 0
            if good.any():
                starts = starts[good]
                out.append((row[starts], starts, np.full(len(starts), length), key[good]))
        return out


def _merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Sorted, disjoint, flat [start, end, start, end, ...]."""
    flat: list[int] = []
    for a, b in sorted(ranges):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _scan_column(texts: pa.Array, index: Index):
    """Per row: number of words, hit ranges, ids of the items."""
    counts: list[int] = []
    ranges: list[list[int]] = []
    found: list[list[str]] = []
    for low, high, body, offsets in slices(texts):
        words = Words(body, offsets, ALNUM)
        counts += words.counts.tolist()
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        for rows, starts, lengths, keys in index.scan(words):
            length = int(lengths[0])
            for row, start in zip(rows.tolist(), starts.tolist()):
                first = start - int(words.rows[row])
                spans.setdefault(row, []).append((first, first + length))
            postings = index.windows[length]
            pairs = np.unique(np.stack([rows, keys]), axis=1)
            for row, key in pairs.T.tolist():
                items.setdefault(row, set()).update(postings.items[postings.bounds[key] : postings.bounds[key + 1]].tolist())
        for row in range(high - low):
            ranges.append(_merged(spans[row]) if row in spans else [])
            found.append(sorted({index.ids[i] for i in items[row]}) if row in items else [])
    return counts, ranges, found


def blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[Index]]:
    """The test side in blocks, each of about block_bytes of text at most: their number, and one at a time on the driver."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), text_of(benchmark, item_text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))

    def made():
        for k in range(n):
            got = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()
            yield Index([r[0] for r in got], [r[1] for r in got])

    return n, made()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, str]:
    """docs with one more column, a struct (n_words, ranges, items), and that column's name.

    ranges: flat, disjoint [start, end) word ranges that windows of the test side
    cover; items: sorted ids of the items with an occurring window.
    """
    spark = prepare(docs.sparkSession)
    name = free_name(docs, "contamination")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _RESULT)])
    n, indexes = blocks(benchmark, item_id, item_text, block_bytes)
    width, at = len(docs.columns), docs.columns.index(text)
    if n == 1:
        held = spark.sparkContext.broadcast(next(indexes))

        def scan(batches):
            for batch in batches:
                yield _with_result(batch, width, _scan_column(batch.column(at), held.value), schema.names)

        return docs.mapInArrow(scan, schema), name

    # equal texts have equal hits: texts go by two hashes, 128 bits in all
    keys = [free_name(docs, c) for c in ("text_key_a", "text_key_b")]
    body = text_of(docs, text)
    key = {k: F.xxhash64(F.lit(i), body) for i, k in enumerate(keys)}
    texts, parts = docs.select(body.alias("t"), *[v.alias(k) for k, v in key.items()]), None
    for index in indexes:
        held = spark.sparkContext.broadcast(index)

        def hits(batches, held=held):
            for batch in batches:
                _, ranges, found = _scan_column(batch.column(0), held.value)
                some = [i for i, x in enumerate(found) if x]
                take = pa.array(some, pa.int64())
                lists = [pa.array([x[i] for i in some], _ARROW[k].type) for k, x in ((1, ranges), (2, found))]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), *lists], names=[*keys, "ranges", "items"])

        own = cut(texts.mapInArrow(hits, f"{keys[0]} long, {keys[1]} long, ranges array<int>, items array<string>").dropDuplicates(keys))
        held.destroy()
        parts = own if parts is None else parts.union(own)
    lists = [free_name(docs, c) for c in ("hit_ranges", "hit_items")]
    merged = parts.groupBy(*keys).agg(*[F.collect_list(c).alias(x) for c, x in zip(("ranges", "items"), lists)])  # one entry a block at most
    joined = docs.withColumns(key).join(merged, keys, "left").select(*docs.columns, *lists)

    def merge(batches):
        for batch in batches:
            counts = [n for _, _, own, offsets in slices(batch.column(at)) for n in Words(own, offsets, ALNUM).counts.tolist()]
            old = [[x or [] for x in batch.column(width + i).to_pylist()] for i in (0, 1)]
            ranges = [_merged([r for flat in x for r in zip(flat[::2], flat[1::2])]) for x in old[0]]
            yield _with_result(batch, width, (counts, ranges, [sorted({i for own in x for i in own}) for x in old[1]]), schema.names)

    return joined.mapInArrow(merge, schema), name


_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("ranges", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _with_result(batch: pa.RecordBatch, width: int, found: tuple[list, list, list], names: list[str]) -> pa.RecordBatch:
    result = pa.StructArray.from_arrays([pa.array(x, kind.type) for x, kind in zip(found, _ARROW)], fields=list(_ARROW))
    return pa.RecordBatch.from_arrays([*batch.columns[:width], result], names=names)


def hit_count(name: str):
    """Number of hit words in a result of find_contamination."""
    ranges = F.col(name)["ranges"]
    pairs = F.transform(ranges, lambda x, i: F.when(i % 2 == 1, x.cast("long")).otherwise(-x.cast("long")))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)


def is_contaminated(name: str):
    """Hit, and one word in twenty or more of it."""
    return (hit_count(name) > 0) & (F.lit(20) * hit_count(name) >= F.col(name)["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    marked, name = find_contamination(docs, benchmark, **options)
    return marked.where(~is_contaminated(name)).drop(name)
