"""Substring dedup by recompression.

Each document's word sequence is recompressed in rounds: maximal runs of one
symbol get the name of (symbol, length), then pairs whose left symbol falls in
one half of the alphabet and whose right symbol falls in the other get the name
of the pair. Names are 64-bit fingerprints of what they stand for, so every
worker gives equal things the same name, in every round, without an exchange:
naming is global. With each symbol goes its *support*, the stretch of words that
settled it; after the last round that is more than half of a window. Two equal
windows of words hold the same symbols wherever their support lies inside, so a
window is named by the symbol with the longest support in it (one that has none,
as in a long run, is one symbol itself).

1. Windows that follow each other under one symbol are an occurrence of it. The
   occurrences of all documents meet by the symbol's name. Symbols that occur
   once go, and their windows with them.
2. From a shared symbol its windows extend over the words around it: those with
   the same print of all their words are equal. All but the earliest are repeats.
3. Repeats are brought back to their documents as spans, and the words they
   cover are removed.

Hot symbols: a task sends each different window once; repeats of its own are
settled at once. A symbol that even so has many windows in one task (``HOT``) is
named to the group that owns it; its windows, those other tasks have sent there
too, are dealt again by symbol and print, and so spread over all groups. The
number of groups follows from the size of the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, fresh_dir, parts_for, pick, release, settle, slices
from .flags import flag, flagged, load_flags
from .packed import _pack, _split, _unpack  # noqa: F401
from .words import mix, range_hash, words

WINDOW = 20
#: Windows of one symbol in one task's batch from which they are dealt by window.
HOT = 128
#: Bytes of text worked through at once.
SLICE_BYTES = 1_500_000
NO_ID = -(1 << 63)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FAR = 1 << 40


# ---- recompression


def _named(x: np.ndarray, y: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(x + np.uint64(kind)) * np.uint64(0x9FB21C651E98DF25) + y)


def symbols(values: np.ndarray, owner: np.ndarray, rounds: int) -> tuple[np.ndarray, ...]:
    """Recompress the sequences in ``values`` (``owner``: which sequence, never
    descending). Returns name, begin, end, support begin, support end."""
    n = len(values)
    name, own = values.copy(), owner
    at = np.arange(n)
    begin, end, lo, hi = at, at + 1, at, at + 1
    for r in range(rounds):
        if not len(name):
            break
        # runs
        fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (own[1:] != own[:-1])])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(name)) - 1
        size = tail - head + 1
        new_lo, new_hi = np.minimum.reduceat(lo, head), np.maximum.reduceat(hi, head)
        # what a run ends at belongs to its support; beyond an end of the sequence nothing is known
        same_before = np.concatenate([[False], own[head[1:]] == own[head[1:] - 1]])
        same_after = np.append(same_before[1:], False)
        new_lo = np.where(same_before, np.minimum(new_lo, lo[np.maximum(head - 1, 0)]), -_FAR)
        new_hi = np.where(same_after, np.maximum(new_hi, hi[np.minimum(tail + 1, len(name) - 1)]), _FAR)
        name = np.where(size > 1, _named(name[head], size.astype(np.uint64), 3 * r + 1), name[head])
        begin, end, own, lo, hi = begin[head], end[tail], own[head], new_lo, new_hi
        # pairs
        left = (mix(name + np.uint64(7919 * (r + 1))) >> np.uint64(63)).astype(bool)
        if len(name) < 2:
            break
        next_to = own[1:] == own[:-1]
        merge = np.append(left[:-1] & ~left[1:] & next_to, False)
        second = np.concatenate([[False], merge[:-1]])
        after, before = np.append(next_to, False), np.concatenate([[False], next_to])
        nxt_hi, prv_lo = np.append(hi[1:], 0), np.concatenate([[0], lo[:-1]])
        # alone: a left symbol has seen its successor, a right one its predecessor
        alone_hi = np.where(left, np.where(after, np.maximum(hi, nxt_hi), _FAR), hi)
        alone_lo = np.where(~left, np.where(before, np.minimum(lo, prv_lo), -_FAR), lo)
        nxt_name, nxt_end, nxt_lo = np.append(name[1:], 0).astype(np.uint64), np.append(end[1:], 0), np.append(lo[1:], 0)
        keep = ~second
        name = np.where(merge, _named(name, nxt_name, 3 * r + 2), name)[keep]
        end = np.where(merge, nxt_end, end)[keep]
        lo, hi = np.where(merge, np.minimum(lo, nxt_lo), alone_lo)[keep], np.where(merge, np.maximum(hi, nxt_hi), alone_hi)[keep]
        begin, own = begin[keep], own[keep]
    return name, begin, end, lo, hi


def window_symbols(values: np.ndarray, owner: np.ndarray, width: int, segment: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """For stretches of the sequences: (begin of each window of ``width`` words,
    name of its symbol, print of its words). A segment overlaps the next by
    width - 1 words; a window's symbol depends on the window alone."""
    none = np.uint64(np.iinfo(np.uint64).max)
    for a in range(0, max(1, len(values) - width + 1), segment):
        v, own = values[a : a + segment + width - 1], owner[a : a + segment + width - 1]
        n = len(v)
        if n < width:
            return
        name, _, _, lo, hi = symbols(v, own, max(1, width.bit_length() - 2))
        fits = (lo >= 0) & (hi <= n) & (hi - lo <= width)
        name, lo, hi = name[fits], lo[fits], hi[fits]
        # longest support first; of equal length the smallest name
        order = ((width - (hi - lo)).astype(np.uint64) << np.uint64(56)) | (mix(name) >> np.uint64(8))
        # each symbol serves the windows that begin in [hi - width, lo]; minima by doubling blocks
        first = np.maximum(hi - width, 0)
        level = np.floor(np.log2(lo - first + 1)).astype(np.int64)
        best = np.full(n, none)
        for k in range(width.bit_length(), -1, -1):
            mine = level == k
            np.minimum.at(best, first[mine], order[mine])
            np.minimum.at(best, lo[mine] - (1 << k) + 1, order[mine])
            half = 1 << k >> 1
            if half and half < n:
                best[half:] = np.minimum(best[half:], best[:-half])
        at = np.flatnonzero(own[: n - width + 1] == own[width - 1 :])
        symbol = best[at]
        bare = np.flatnonzero(symbol == none)
        symbol = mix(symbol)
        symbol[bare] = range_hash(v)(at[bare], at[bare] + width)
        yield at + a, symbol, range_hash(v, salt=1)(at, at + width)


# ---- packed arrays


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.int64), prepend=0).astype(np.int32)


def _places(doc: np.ndarray, tie: np.ndarray, idx: np.ndarray, pos: np.ndarray) -> bytes:
    """Pack (document, place) pairs with the table of the documents in use."""
    used, idx = np.unique(idx, return_inverse=True)
    return _pack(np.diff(doc[used], prepend=0), tie[used].astype("<i4"), _delta(idx), _delta(pos))


class _Docs:
    """Documents of many packed tables, numbered in the order (doc, tie)."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        doc, tie = (np.concatenate([t[k] for t in tables]) for k in (0, 1))
        order = np.lexsort((tie, doc))
        new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(tie[order]) != 0)]) if len(order) else np.empty(0, bool)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.doc, self.tie = doc[order][new], tie[order][new]


def _repeats(symbol: np.ndarray, print_: np.ndarray, idx: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, which of it don't start where their window starts first)."""
    place = (idx.astype(np.uint64) << np.uint64(40)) | pos.astype(np.uint64)
    order = np.lexsort((place, print_, symbol))
    a, b, place = symbol[order], print_[order], place[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(order) else np.empty(0, np.int64)
    return order, place != np.repeat(place[head], np.diff(np.append(head, len(order))))


def _doc_bucket(doc: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64) ^ mix(tie.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


# ---- occurrences of symbols


class _Windows:
    """Windows as they travel: occurrences of symbols (a stretch of windows of
    one document that follow each other) with 40 bits of the name, 48 bits of
    print for each window, and the names of symbols to be dealt by window."""

    KINDS = ("<i8", "<i4", "<u4", "u1", "<i4", "<i4", "<i4", "<u4", "<u2", "<u8")

    @staticmethod
    def pack(doc: np.ndarray, tie: np.ndarray, idx: np.ndarray, pos: np.ndarray, symbol: np.ndarray, print_: np.ndarray, hot: np.ndarray) -> bytes:
        new = np.ones(len(idx), bool)
        new[1:] = (idx[1:] != idx[:-1]) | (pos[1:] != pos[:-1] + 1) | (symbol[1:] != symbol[:-1])
        head = np.flatnonzero(new)
        used, own = np.unique(idx[head], return_inverse=True)
        size = np.diff(np.append(head, len(idx))).astype("<i4")
        return _pack(np.diff(doc[used], prepend=0), tie[used].astype("<i4"), (symbol[head] >> np.uint64(8)).astype("<u4"), symbol[head].astype("u1"), _delta(own), _delta(pos[head]), size, (print_ >> np.uint64(16)).astype("<u4"), print_.astype("<u2"), hot.astype("<u8"))

    def __init__(self, packed: list[memoryview]):
        """Put packed windows together. ``symbol, idx, pos, size`` by occurrence,
        ``high, low`` by window, ``at`` where the windows of an occurrence begin."""
        parts = [_unpack(b, *self.KINDS) for b in packed]
        self.docs, at, idx = _Docs([(np.cumsum(p[0]), p[1]) for p in parts]), 0, []
        for p in parts:
            idx.append(self.docs.number[at + np.cumsum(p[4], dtype=np.int64)])
            at += len(p[0])
        of = lambda k: np.concatenate([p[k] for p in parts])
        self.idx, self.symbol = np.concatenate(idx), (of(2).astype(np.uint64) << np.uint64(8)) | of(3)
        self.high, self.low = of(7), of(8)  # of the prints
        self.pos = np.concatenate([np.cumsum(p[5], dtype=np.int64) for p in parts])
        self.size = np.concatenate([p[6] for p in parts]).astype(np.int64)
        self.hot = np.unique(np.concatenate([p[9] for p in parts]))
        self.at = np.cumsum(self.size) - self.size

    def of(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(symbol, print, document, place) of the windows of these occurrences."""
        size = self.size[which]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(self.at[which], size) + within
        return np.repeat(self.symbol[which], size), (self.high[at].astype(np.uint64) << np.uint64(16)) | self.low[at], np.repeat(self.idx[which], size), np.repeat(self.pos[which], size) + within


def _owner(symbol: np.ndarray, n: int) -> np.ndarray:
    return (mix(symbol) % np.uint64(n)).astype(np.int64)


def _spread(symbol: np.ndarray, print_: np.ndarray, n: int) -> np.ndarray:
    return (mix(symbol ^ mix(print_)) % np.uint64(n)).astype(np.int64)


def _in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _rows(made: list[tuple[int, bytes]]) -> dict[str, pa.Array]:
    return {"part": pa.array([k for k, _ in made], pa.int32()), "blob": pa.array([b for _, b in made], pa.binary())}


# ---- repeats


def repeated_spans(rows: DataFrame, width: int = WINDOW, batch_windows: int = 1_000_000) -> DataFrame:
    """``doc, tie, spans`` (int32 pairs of word places, packed) of the stretches
    covered by windows that also start earlier; rows ``doc, tie, text``."""
    n_out = parts_for(rows)
    packed = "part int, blob binary"
    # parts 0..n_out: occurrences by symbol; then windows of hot symbols by window; then repeats by document

    def back(docs: _Docs, idx: np.ndarray, pos: np.ndarray) -> list[tuple[int, bytes]]:
        order = np.lexsort((pos, idx))
        idx, pos = idx[order], pos[order]
        return [(2 * n_out + k, _places(docs.doc, docs.tie, idx[x], pos[x])) for k, x in _split(_doc_bucket(docs.doc, docs.tie, n_out)[idx], n_out)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, ties, held, n_docs, n = [], [], [], 0, 0

        def flush():
            known = _Docs([(np.concatenate(docs), np.concatenate(ties))])
            symbol, print_, idx, pos = (np.concatenate(x) for x in zip(*held))
            symbol, print_, idx = symbol >> np.uint64(24), print_ >> np.uint64(16), known.number[idx]
            # windows that are here more than once: the earliest goes on, the others are repeats already
            both = symbol ^ mix(print_)
            order = np.argsort(both)
            again = both[order[1:]] == both[order[:-1]]
            several = order[np.append(again, False) | np.concatenate([[False], again])] if n else order
            of, repeated = _repeats(symbol[several], print_[several], idx[several], pos[several])
            goes_on = np.ones(len(symbol), bool)
            goes_on[several[of[repeated]]] = False
            made = back(known, idx[~goes_on], pos[~goes_on])
            symbol, print_, idx, pos = symbol[goes_on], print_[goes_on], idx[goes_on], pos[goes_on]
            by_name = np.sort(symbol)
            head = np.flatnonzero(np.concatenate([[True], by_name[1:] != by_name[:-1]]))
            hot = by_name[head[np.diff(np.append(head, len(by_name))) > HOT]]
            is_hot = _in(symbol, hot)
            send = lambda x, names: _Windows.pack(known.doc, known.tie, idx[x], pos[x], symbol[x], print_[x], names)
            owner_of_hot, none = _owner(hot, n_out), np.empty(0, np.uint64)
            part = np.where(is_hot, n_out + _spread(symbol, print_, n_out), _owner(symbol, n_out))
            for k, x in _split(part, 2 * n_out):
                made.append((k, send(x, none)))
            for k, x in _split(owner_of_hot, n_out):
                made.append((k, send(np.empty(0, np.int64), hot[x])))
            return pa.RecordBatch.from_pydict(_rows(made))

        for batch in slices(batches, "text", SLICE_BYTES):
            values, at = words(batch.column(batch.schema.get_field_index("text")), block=SLICE_BYTES // 2)
            docs.append(batch.column(0).to_numpy(zero_copy_only=False))
            ties.append(batch.column(1).to_numpy(zero_copy_only=False))
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for begin, symbol, print_ in window_symbols(values, owner, width):
                own = owner[begin]
                held.append((symbol, print_, own + n_docs, begin - at[own]))
                n += len(begin)
            n_docs += batch.num_rows
            if n > batch_windows:
                yield flush()
                docs, ties, held, n_docs, n = [], [], [], 0, 0
        if n:
            yield flush()
        held.clear()
        release()

    def reveal(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= n_out:
            return table
        met = _Windows(blobs(table))
        order = np.argsort(met.symbol, kind="stable")
        name = met.symbol[order]
        same = name[1:] == name[:-1]
        shared = np.append(same, False) | np.concatenate([[False], same]) if len(order) else np.empty(0, bool)
        is_hot = _in(name, met.hot)
        symbol, print_, idx, pos = met.of(order[shared & ~is_hot])
        of, repeated = _repeats(symbol, print_, idx, pos)
        mine = of[repeated]
        made = back(met.docs, idx[mine], pos[mine])
        symbol, print_, idx, pos = met.of(np.sort(order[is_hot]))
        for k, x in _split(_spread(symbol, print_, n_out), n_out):
            made.append((n_out + k, _Windows.pack(met.docs.doc, met.docs.tie, idx[x], pos[x], symbol[x], print_[x], np.empty(0, np.uint64))))
        del met, symbol, print_, idx, pos, order, name
        release()
        return pa.table(_rows(made))

    def verify(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= 2 * n_out:
            return table
        met = _Windows(blobs(table))
        symbol, print_, idx, pos = met.of(np.arange(len(met.symbol)))
        of, repeated = _repeats(symbol, print_, idx, pos)
        mine = of[repeated]
        return pa.table(_rows(back(met.docs, idx[mine], pos[mine])))

    def cover(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, "<i8", "<i4", "<i4", "<i4") for b in blobs(table)]
        known, at, idx = _Docs([(np.cumsum(p[0]), p[1]) for p in parts]), 0, []
        for p in parts:
            idx.append(known.number[at + np.cumsum(p[2], dtype=np.int64)])
            at += len(p[0])
        place = np.unique((np.concatenate(idx) << 40) | np.concatenate([np.cumsum(p[3], dtype=np.int64) for p in parts]))
        jump = np.concatenate([[True], np.diff(place) > width])  # another document is far away, too
        first, last = place[jump], place[np.append(np.flatnonzero(jump)[1:] - 1, len(place) - 1)] + width
        own, low = first >> 40, (1 << 40) - 1
        spans = np.stack([first & low, last & low], 1).astype("<i4")
        ends = np.append(np.flatnonzero(np.diff(own)) + 1, len(own))
        begins = np.concatenate([[0], ends[:-1]])
        return pa.table({"doc": known.doc[own[begins]], "tie": known.tie[own[begins]], "spans": pa.array([spans[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())})

    dealt = lambda df: df.repartition(n_out, "part").groupBy("part")
    found = rows.select("doc", "tie", "text").mapInArrow(find, packed)
    verified = dealt(dealt(found).applyInArrow(reveal, packed)).applyInArrow(verify, packed)
    return dealt(verified).applyInArrow(cover, "doc bigint, tie int, spans binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept`` (the kept
    words joined by one space) and ``spans`` (array of begin, end word places).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes iff a window of
    ``width`` consecutive words of its document covers it and the same window
    also starts earlier (smaller identifier, or same document and earlier);
    windows are judged on the input. Null and empty texts have no words. A null
    identifier comes first. Rows with the same identifier and text are one
    document; rows that share only the identifier are ordered by a hash of
    their text. Other columns are not read.
    """
    rows = pick(df, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("tie", F.shiftright(F.xxhash64("text"), 32).cast("int"))
    spans = repeated_spans(rows.select("doc", "tie", "text"), width)

    def clean(ids: pa.Array, found: list[str | None], packed: list[bytes | None]) -> pa.RecordBatch:
        size, gone, kept, where = [], [], [], []
        for words_, spans in zip(map(_WORD.findall, found), packed):
            pairs = np.frombuffer(spans or b"", "<i4").tolist()
            left, at = [], 0
            for a, b in zip(pairs[::2], pairs[1::2]):
                left += words_[at:a]
                at = b
            left += words_[at:]
            size.append(len(words_))
            gone.append(len(words_) - len(left))
            kept.append(" ".join(left))
            where.append(pairs)
        return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(where, pa.list_(pa.int32()))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    out = "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<int>"
    n, spans = parts_for(rows), settle(spans, "spans")
    seen = flag(spans.select("doc", "tie"), fresh_dir(df.sparkSession, "spans"))

    def has_spans(batch: pa.RecordBatch) -> np.ndarray:
        """For all the filter knows, whether a row's document has spans."""
        return flagged(load_flags("recompression", seen), batch.column(1).to_numpy(), batch.column(2).to_numpy())

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            yield batch.filter(pa.array(has_spans(batch)))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            batch = batch.filter(pa.array(~has_spans(batch)))
            yield clean(batch.column(0), batch.column(3).to_pylist(), [None] * batch.num_rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            yield clean(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    rows = rows.select("doc_id", "doc", "tie", "text")
    moved = rows if seen is None else rows.mapInArrow(touched, "doc_id bigint, doc bigint, tie int, text string")  # only these texts move
    result = moved.repartition(n, "doc", "tie").join(spans.repartition(n, "doc", "tie"), ["doc", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(joined, out)
    return result if seen is None else result.unionByName(rows.mapInArrow(untouched, out))
