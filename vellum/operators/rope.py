"""Edits of running texts, composed in parts.

An edit is a script of runs: ranges kept of the text before it, and pieces put in.  The
script of two edits in a row has at most the runs of both, cut where they meet, and
composing is associative: so a document's edits are cut into parts of PART, parts are composed
side by side, edits pairwise, the results pairwise and so on (log PART steps, each
over all pairs of a batch at once), and the parts' scripts are composed by FAN at a time on
the executors until a document has one.  It is applied to the document's text once.

Edits that reach outside the text do nothing, and whether they do depends on its length
by then.  Over a part that is one of two things: a length that suffices for all of its edits, with
the change that they make to it, or, for a text that is shorter, a walk over its numbers.  A
pass over the parts in order, a document after the other, carries one length.

Edits are dealt out by ranges of (document, sequence): a document with very many edits
spreads over tasks, those that have few share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written

PART, FAN = 4096, 16
#: Edits of the parts that a worker holds in numpy at once; a part is never cut.
AT_ONCE = 1 << 16
_NEVER = 1 << 62
_SCRIPT = "src array<bigint>, size array<bigint>, pool string"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _within(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(_offsets(counts)[:-1], counts)


def _slices(batches, column: int):
    """Batches cut into runs of rows whose lists in ``column`` have about AT_ONCE items."""
    for batch in batches:
        part = np.cumsum(batch.column(column).value_lengths().to_numpy()) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b)


class Scripts:
    """Scripts one after the other, as runs: ``of`` their script, ``src`` where they start in the text before it, or -1 - p for position p of the pool, and their size."""

    def __init__(self, of: np.ndarray, src: np.ndarray, size: np.ndarray):
        keep = size > 0
        of, src, size = of[keep], src[keep], size[keep]
        # a run that goes on where the one before it ends is one with it
        goes_on = (of[1:] == of[:-1]) & ((src[1:] >= 0) == (src[:-1] >= 0)) & (src[1:] == src[:-1] + np.where(src[:-1] >= 0, size[:-1], -size[:-1]))
        first = np.flatnonzero(np.append(True, ~goes_on)[: len(of)])
        self.of, self.src = of[first], src[first]
        self.size = np.add.reduceat(size, first) if len(first) else size

    def paired(self, counts: np.ndarray) -> Scripts:
        """Each group's first script with its second, its third with its fourth and so on; a last one without a pair stays.  counts: scripts of each group."""
        group = np.repeat(np.arange(len(counts)), counts)[self.of]
        local = self.of - _offsets(counts)[group]
        pair = _offsets((counts + 1) // 2)[group] + local // 2
        early, late = np.flatnonzero(local % 2 == 0), np.flatnonzero(local % 2)
        alone = early[local[early] == counts[group[early]] - 1]
        # the early ones' results one after the other; where each pair's begins
        a_src, a_ends = self.src[early], np.cumsum(self.size[early])
        a_starts = a_ends - self.size[early]
        base = _offsets(np.bincount(pair[early], weights=self.size[early], minlength=((counts + 1) // 2).sum()))
        kept = self.src[late] >= 0
        low = base[pair[late]] + np.maximum(self.src[late], 0)
        high = low + self.size[late]
        lo = np.searchsorted(a_ends, low, side="right")
        n = np.where(kept, np.searchsorted(a_starts, high, side="left") - lo, 1)
        run = np.repeat(np.arange(len(late)), n)
        src, size = self.src[late][run], self.size[late][run]
        through = np.flatnonzero(kept[run])
        at, of = (lo[run] + _within(n))[through], run[through]
        begin = np.maximum(a_starts[at], low[of])
        shift = begin - a_starts[at]
        src[through] = a_src[at] + np.where(a_src[at] >= 0, shift, -shift)
        size[through] = np.minimum(a_ends[at], high[of]) - begin
        to = np.concatenate([pair[late][run], pair[alone]])
        order = np.argsort(to, kind="stable")
        return Scripts(to[order], np.concatenate([src, self.src[alone]])[order], np.concatenate([size, self.size[alone]])[order])

    def composed(self, counts: np.ndarray) -> Scripts:
        """One script for each group."""
        out = self
        while (counts > 1).any():
            out, counts = out.paired(counts), (counts + 1) // 2
        return out

    def batch(self, groups: int, pool: np.ndarray) -> list[pa.Array]:
        """Columns src, size and pool of one script a group, each with what it uses of the pool, in order."""
        put = self.src < 0
        letters = np.where(put, self.size, 0)
        used = pool[np.repeat(-1 - self.src[put], letters[put]) + _within(letters[put])]
        runs, upto = np.searchsorted(self.of, np.arange(groups + 1)), _offsets(letters)
        text, cuts = _text(used), upto[runs]
        src = np.where(put, -1 - (upto[:-1] - cuts[self.of]), self.src)
        lists = [pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.array(x, pa.int64())) for x in (src, self.size)]
        return [*lists, pa.array([text[a:b] for a, b in zip(cuts, cuts[1:])], pa.string())]


def _needs(op: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length that each edit needs, and how it changes it."""
    insert, delete, replace = op == "insert", op == "delete", op == "replace"
    good = (start >= 0) & (insert | (delete & (start < end)) | (replace & (start <= end)))
    need = np.where(good, np.where(insert, start, end), _NEVER)
    return need, np.where(good, np.where(insert, letters, np.where(replace, letters, 0) - (end - start)), 0)


def _takes_place(length: int, need: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, int]:
    """(whether each edit takes place, the length after all)."""
    some = need < _NEVER
    if length >= np.max((need - (np.cumsum(change) - change))[some], initial=0):  # enough for all that any length is enough for
        return some, length + int(change.sum())
    done = np.zeros(len(need), bool)
    for i in np.flatnonzero(some).tolist():
        if length >= need[i]:
            done[i] = True
            length += int(change[i])
    return done, length


def _parts(edits: DataFrame, part: int) -> DataFrame:
    """(at, doc_id, op, start, end, piece, need, change): consecutive edits of a document as arrays; at: in order of document and sequence."""
    null = F.col("start").isNull() | F.col("end").isNull() & (F.col("op") != "insert")
    sort = ["doc_id", "seq", "op", "start", "end", "piece"]
    named = edits.select(F.col("doc_id").cast("long").alias("doc_id"), "seq", F.when(null, "").otherwise(F.coalesce("op", F.lit(""))).alias("op"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("start", "end")], F.coalesce("piece", F.lit("")).alias("piece"))
    ordered = named.repartitionByRange("doc_id", "seq").sortWithinPartitions(*sort)

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not len(batch):
                continue
            doc, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])))
            sizes = np.diff(np.append(first, len(doc)))
            each = -(-sizes // part)
            begins = np.repeat(first, each) + _within(each) * part
            op, piece = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            need, change = _needs(op, batch.column(3).to_numpy(), batch.column(4).to_numpy(), np.fromiter(map(len, piece), np.int64, len(piece)))
            bounds = pa.array(np.append(begins, len(doc)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, c) for c in (*batch.columns[2:6], pa.array(need, pa.int64()), pa.array(change, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(begins))), batch.column(0).take(pa.array(begins)), *lists], names=["at", "doc_id", "op", "start", "end", "piece", "need", "change"])
            at += len(begins)

    return ordered.mapInArrow(run, "at long, doc_id long, op array<string>, start array<bigint>, end array<bigint>, piece array<string>, need array<bigint>, change array<bigint>")


def _lengths(parts: DataFrame) -> DataFrame:
    """(at, number, length): each part's number in its document, and the length of the text before it.  parts: with the length of the text before all."""

    def run(batches):
        last, number, length = object(), 0, 0
        for batch in _slices(batches, 3):
            numbers, lengths = [], []
            need, change = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            cuts = _offsets(batch.column(3).value_lengths().to_numpy())
            for doc, own, a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), cuts, cuts[1:]):
                number, length = (number + 1, length) if doc == last else (0, own)
                last = doc
                numbers.append(number)
                lengths.append(length)
                length = _takes_place(length, need[a:b], change[a:b])[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(lengths, pa.int64())], names=["at", "number", "length"])

    own = parts.select("at", "doc_id", "length", "need", "change")
    return own.repartition("doc_id").sortWithinPartitions("doc_id", "at").mapInArrow(run, "at long, number long, length long")


def _part_scripts(parts: DataFrame) -> DataFrame:
    """(doc_id, number, src, size, pool) of parts with their number and the length of the text before them; all parts of a batch are composed at once."""

    def run(batches):
        for batch in _slices(batches, 3):
            op, start, end, piece, need, change = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3, 9))
            cuts, lengths = _offsets(batch.column(3).value_lengths().to_numpy()), batch.column(2).to_numpy()
            done = np.concatenate([_takes_place(int(n), need[a:b], change[a:b])[0] for n, a, b in zip(lengths, cuts, cuts[1:])] or [np.zeros(0, bool)])
            part = np.repeat(np.arange(len(batch)), np.diff(cuts))[done]
            op, start, end, piece, change = op[done], start[done], end[done], piece[done], change[done]
            counts = np.bincount(part, minlength=len(batch))
            total = np.cumsum(change) - change
            first = np.minimum(_offsets(counts)[:-1], max(len(total) - 1, 0))
            before = lengths[part] + total - (total[first][part] if len(total) else 0)
            upto = np.where(op == "insert", start, end)
            letters = np.where(op == "delete", 0, np.fromiter(map(len, piece), np.int64, len(piece)))
            # each edit: what stands before it, its piece, what comes after; a part without edits keeps its text
            none = np.flatnonzero(counts == 0)
            script = np.arange(len(part)) + np.cumsum(counts == 0)[part] if len(none) else np.arange(len(part))
            src = np.stack([np.zeros(len(part), np.int64), -1 - (np.cumsum(letters) - letters), upto], axis=1).ravel()
            size = np.stack([start, letters, before - upto], axis=1).ravel()
            counts = np.maximum(counts, 1)
            of = np.concatenate([np.repeat(script, 3), _offsets(counts)[none]])
            order = np.argsort(of, kind="stable")
            made = Scripts(of[order], np.concatenate([src, np.zeros(len(none), np.int64)])[order], np.concatenate([size, lengths[none]])[order])
            pool = _codes("".join(p for p, o in zip(piece, op) if o != "delete"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made.composed(counts).batch(len(batch), pool)], names=["doc_id", "number", "src", "size", "pool"])

    return parts.select("doc_id", "number", "length", "op", "start", "end", "piece", "need", "change").mapInArrow(run, f"doc_id long, number long, {_SCRIPT}")


def _neighbours(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Scripts of one document as one, in order of their number."""
    table = table.sort_by("number").combine_chunks()
    src, size = (table[c].chunk(0).flatten().to_numpy() for c in ("src", "size"))
    of = np.repeat(np.arange(len(table)), table["src"].chunk(0).value_lengths().to_numpy())
    pools = table["pool"].to_pylist()
    first = _offsets(np.fromiter(map(len, pools), np.int64, len(pools)))
    made = Scripts(of, np.where(src < 0, src - first[of], src), size).composed(np.array([len(table)]))
    return pa.Table.from_arrays([pa.array([k.as_py()], pa.int64()) for k in key] + made.batch(1, _codes("".join(pools))), names=["doc_id", "number", "src", "size", "pool"])


def _composed(scripts: DataFrame) -> DataFrame:
    """(doc_id, src, size, pool): one script a document, of scripts (doc_id, number, ...); FAN neighbours are composed at a time, documents of one part stay as they are."""
    several = scripts.where("number = 1").select(F.col("doc_id").alias("_doc"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    single, many = scripts.join(several, same, "left_anti"), scripts.join(several, same, "left_semi")
    most = scripts.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    while most > 0:
        many = many.groupBy("doc_id", F.expr(f"number div {FAN}").alias("_group")).applyInArrow(_neighbours, f"doc_id long, number long, {_SCRIPT}")
        most //= FAN
    return single.union(many).drop("number")


def _applied(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, src, size, pool, text): scripts on their texts; a text without a script stays."""

    def run(batches):
        for batch in batches:
            out = []
            for src, size, pool, text in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if pool is not None:
                    src, size, before = src.values.to_numpy(), size.values.to_numpy(), _codes(text)
                    at = np.where(src < 0, len(before) - 1 - src, src)
                    text = _text(np.concatenate([before, _codes(pool)])[np.repeat(at, size) + _within(size)])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "src", "size", "pool", "text").mapInArrow(run, "doc_id long, text string")


def replayed_text(edits: DataFrame, texts: DataFrame | None = None, part: int = PART) -> DataFrame:
    """(doc_id, text): the text after edits (doc_id, seq, op, start, end, piece), each on the text that the one before left.

    op: insert at start, delete or replace from start to end; edits that reach outside do nothing, and neither do
    those of another op or without a place.  Edits of one seq come in order of op, start, end and piece.
    texts: (doc_id, text) before the edits, one row a document; empty for documents that it lacks.  Documents without edits keep theirs.
    """
    parts, same = _parts(edits, part), F.col("doc_id").eqNullSafe(F.col("_doc"))
    own = None if texts is None else texts.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    if own is None:
        parts = parts.withColumn("length", F.lit(0).cast("long"))
    else:
        sizes = own.select("_doc", F.length("text").cast("long").alias("length"))
        parts = parts.join(sizes, same, "left").drop("_doc").withColumn("length", F.coalesce("length", F.lit(0)))
    # written once: ranges are drawn anew each time that they are worked out
    parts = written(parts)
    scripts = _composed(written(_part_scripts(parts.drop("length").join(_lengths(parts), "at"))))
    if own is None:
        return _applied(scripts.withColumn("text", F.lit("")))
    both = scripts.join(own, same, "full_outer").select(F.coalesce("doc_id", "_doc").alias("doc_id"), "src", "size", "pool", F.coalesce("text", F.lit("")).alias("text"))
    return _applied(both)
