"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that stands in a text with at most k edits keeps
m + 1 - q(k + 1) of its q-grams, and their diagonals (place in the text minus
place in the passage) drift by no more than k. Shared q-grams are counted in
bands of 2(k + 1) diagonals that overlap by half, so that each such stretch
falls whole into one; bands that meet the bound are verified by an alignment
within the band. For short passages q is smaller, so that the bound is 1 at least.

The passages are worked through in blocks of a stated size, written to the
shared folder; a worker reads one block and keeps its index for all its tasks.
All documents are scanned for each block, map-side, without a shuffle.

What many passages share, a template, meets the bound for all of them. Postings
are therefore expanded in bounded pieces, and alignments run side by side, with
one row of costs for all passages that begin alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, kept, pick, slices, texts

Q, EDIT_PERCENT = 12, 5
#: Characters of passages in one block, and bits of the first filter.
BLOCK_CHARS, FILTER_BITS = 16_000_000, 22
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def code_points(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins and the last ends) with
    every stretch of space or TAB..CR made one space, none at a beginning."""
    c = np.frombuffer("".join(many).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.cumsum([0, *map(len, many)])
    gap = (c == 32) | ((c >= 9) & (c <= 13))
    before = np.concatenate([[True], gap[:-1]])
    before[at[:-1][at[:-1] < len(c)]] = True
    keep = ~(gap & before)
    places = np.concatenate([[0], np.cumsum(keep)])[at]
    return np.where(gap, np.uint32(32), c)[keep], places


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Fingerprint of the q code points from each place on."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        done, out, power, size = 0, None, c.astype(np.uint64) + np.uint64(1), 1
        while done < q:  # by doubling: power holds stretches of 1, 2, 4, ...
            if q & size:
                n = len(c) - done - size + 1
                out = power[:n].copy() if out is None else out[: len(c) - done - size + 1] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done : done + n]
                done += size
            n = len(power) - size
            if size * 2 <= q:
                power = power[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size : size + n]
            size *= 2
        return out


#: Cells of the alignments that run side by side, and postings expanded at once.
CELLS, POSTINGS = 4_000_000, 4_000_000
_NEVER = np.int32(1 << 30)


def align(passages: Passages, item: np.ndarray, c: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, edits: int, places: bool = True) -> tuple[np.ndarray, ...]:
    """Align passages with texts, many pairs side by side: passage ``item[k]``
    with ``c[begin[k]:end[k]]``, its beginning on a diagonal in low - edits ..
    low + 2 * edits + 1. Returns (pair, edits, begin, end) of the pairs with a
    place of at most ``edits`` edits: the fewest edits first, then the earliest
    end and the latest beginning. Without ``places`` only the pairs, at half
    the work.

    The pairs of one text and band whose passages begin alike share one row of
    costs until the passages part; a row whose costs all pass ``edits`` goes,
    and all its pairs with it.
    """
    if not len(item):
        return tuple(np.empty(0, np.int64) for _ in range(4 if places else 1))
    width = 5 * edits + 2
    step = np.arange(width, dtype=np.int32)
    # by text and band, then in the order of the passages; each pair with the depth at which it parts from the one before
    order = np.lexsort((passages.rank[item], low, begin))
    item, begin, end, low = item[order], begin[order], end[order], low[order]
    head = np.concatenate([[True], (begin[1:] != begin[:-1]) | (low[1:] != low[:-1])])
    parts = np.concatenate([[0], passages.shared(item[:-1], item[1:])])
    pair, size, state = order, passages.size[item], np.cumsum(head) - 1
    s_begin, s_lo, s_size = begin[head], (low[head] - 2 * edits).astype(np.int32), (end - begin)[head].astype(np.int32)
    diagonal = s_lo[:, None] + step
    cost = np.where((step >= edits) & (step <= 4 * edits + 1) & (diagonal >= 0) & (diagonal <= s_size[:, None]), np.int32(0), _NEVER)
    first = np.broadcast_to(step if places else step[:1], (len(cost), width if places else 1))  # the beginning's diagonal, counted from s_lo
    found: list[tuple[np.ndarray, ...]] = []
    i, next_end = 0, int(size.min(initial=_NEVER))
    while len(pair):
        if i == next_end:
            done = size == i
            s, mine = state[done], pair[done]
            if places:
                key = (cost[s].astype(np.int64) * (width + 1) + step) * (width + 1) + width - first[s]
                best = key.argmin(axis=1)
                found.append((mine, cost[s, best], s_lo[s] + first[s, best], s_lo[s] + best + i))
            else:
                found.append((mine,))
            pair, size, state, parts, item = (x[~done] for x in (pair, size, state, parts, item))
            if not len(pair):
                break
            next_end = int(size.min())
        # passages that part here get a row of their own
        new = np.concatenate([[True], (state[1:] != state[:-1]) | (parts[1:] == i)])
        source = state[new]
        state = np.cumsum(new) - 1
        if len(source) != len(cost) or (source[1:] == source[:-1]).any():
            cost, first, s_begin, s_lo, s_size = cost[source], first[source], s_begin[source], s_lo[source], s_size[source]
        letter = passages.flat[passages.start[item[new]] + i]
        i += 1
        place = (s_lo + np.int32(i))[:, None] + step  # text[:place] is used
        inside = (place >= 1) & (place <= s_size[:, None])
        differs = np.take(c, place + (s_begin - 1)[:, None], mode="clip") != letter[:, None]
        new = np.where(inside, cost + differs, _NEVER)  # match or change
        drop = np.where(inside | (place == 0), np.append(cost[:, 1:], np.full((len(cost), 1), _NEVER), axis=1) + np.int32(1), _NEVER)  # a character of the passage is missing
        if places:
            new_first = np.where(drop < new, np.append(first[:, 1:], first[:, -1:], axis=1), first)
        new = np.minimum(new, drop)
        # a character of the text is extra: cost runs on to the right
        level = new - step
        least = np.minimum.accumulate(level, axis=1)
        run = least + step
        use = (run < new) & inside
        cost = np.where(use, run, new)
        if places:
            source = np.maximum.accumulate(np.where(level == least, step, 0), axis=1)
            first = np.where(use, np.take_along_axis(new_first, source, 1), new_first)
        alive = cost.min(axis=1) <= edits
        if not alive.all():
            stay = alive[state]
            pair, size, parts, item, state = pair[stay], size[stay], parts[stay], item[stay], (np.cumsum(alive) - 1)[state[stay]]
            next_end = int(size.min(initial=_NEVER))
            cost, first, s_begin, s_lo, s_size = cost[alive], first[alive], s_begin[alive], s_lo[alive], s_size[alive]
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4 if places else 1))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


@dataclass
class Passages:
    """A block of passages with its q-gram postings and first filter."""

    ids: list
    chars: list[np.ndarray]
    q: int
    percent: int

    def __post_init__(self):
        size = np.array([len(c) for c in self.chars], np.int64)
        self.size, self.edits = size, size * self.percent // 100
        self.need = size + 1 - self.q * (self.edits + 1)
        self.flat = np.concatenate([*self.chars, np.empty(0, np.uint32)])
        self.start = np.cumsum(size) - size
        got = [grams(c, self.q) for c in self.chars]
        gram = np.concatenate([*got, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(got)), [len(g) for g in got])
        place = np.concatenate([*(np.arange(len(g)) for g in got), np.empty(0, np.int64)])
        order = np.argsort(gram, kind="stable")  # of equal grams the first owner first
        self.owner, self.place = owner[order], place[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.gram)] = True

    @cached_property
    def rank(self) -> np.ndarray:
        """Each passage's place in the order of the passages."""
        order = sorted(range(len(self.chars)), key=lambda k: self.chars[k].astype(">u4").tobytes())
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order))
        return out

    @cached_property
    def _runs(self) -> list[np.ndarray]:
        """Shared beginnings of 2, 3, 5, 9, ... passages that follow each other."""
        order = np.argsort(self.rank).tolist()
        near = np.zeros(max(0, len(order) - 1), np.int32)
        for k, (a, b) in enumerate(zip(order, order[1:])):
            x, y = self.chars[a], self.chars[b]
            n = min(len(x), len(y))
            differ = x[:n] != y[:n]
            near[k] = int(differ.argmax()) if differ.any() else n
        out = [near]
        while len(out[-1]) > 1 << (len(out) - 1):
            out.append(np.minimum(out[-1][: -(1 << (len(out) - 1))], out[-1][1 << (len(out) - 1) :]))
        return out

    def shared(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many first characters passages have in common."""
        a, b = self.rank[one], self.rank[other]
        a, b = np.minimum(a, b), np.maximum(a, b)
        out = np.where(a == b, self.size[one], 0)
        level = np.log2(np.maximum(b - a, 1)).astype(np.int64)
        for k in np.unique(level[a < b]).tolist():
            x = (level == k) & (a < b)
            out[x] = np.minimum(self._runs[k][a[x]], self._runs[k][b[x] - (1 << k)])
        return out

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((gram * _SPREAD) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def find(self, c: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """{(text, passage): (edits, begin, end, shared q-grams)} of the best
        place of each passage in each text; places count within the text."""
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        g = grams(c, self.q)
        hit = np.flatnonzero(self.filter[self._slot(g)])
        if not len(hit) or not len(self.gram):
            return out
        row = np.searchsorted(self.gram, g[hit])
        row[row == len(self.gram)] = 0
        real = self.gram[row] == g[hit]
        hit, row = hit[real], row[real]
        doc = np.searchsorted(at, hit, side="right") - 1
        whole = hit + self.q <= at[doc + 1]
        hit, row, doc = hit[whole], row[whole], doc[whole]
        # whole texts are expanded together while their postings stay few; a text with more goes alone, by ranges of passages
        total = np.cumsum(self.count[row])
        a = 0
        while a < len(hit):
            done = total[a - 1] if a else 0
            b = int(np.searchsorted(total, done + POSTINGS, side="right"))
            if b < len(hit):
                b = int(np.searchsorted(doc, doc[b]))  # the beginning of the text that doesn't fit
                if b <= a:
                    b = int(np.searchsorted(doc, doc[a], side="right"))
            ranges = -(-int(total[b - 1] - done) // POSTINGS)
            edge = [len(self.ids) * k // ranges for k in range(ranges + 1)]
            for i, j in zip(edge, edge[1:]):
                if i < j:
                    self._verify(c, at, hit[a:b], row[a:b], doc[a:b], (i, j) if ranges > 1 else None, out)
            a = b
        return out

    def _verify(self, c: np.ndarray, at: np.ndarray, hit: np.ndarray, row: np.ndarray, doc: np.ndarray, owners: tuple[int, int] | None, out: dict) -> None:
        """Count the shared q-grams in bands, and align where they suffice."""
        first, n = self.first[row], self.count[row]
        if owners:  # postings of a gram are sorted by owner
            if not hasattr(self, "key"):
                self.key = np.repeat(np.arange(len(self.gram)), self.count) * len(self.ids) + self.owner
            last = np.searchsorted(self.key, row * len(self.ids) + owners[1])
            first = np.searchsorted(self.key, row * len(self.ids) + owners[0])
            n = last - first
        which = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        item, text, diagonal = self.owner[which], np.repeat(doc, n), np.repeat(hit - at[doc], n) - self.place[which]
        band = diagonal // (self.edits[item] + 1)  # below 0 where the text begins inside the passage
        order = np.lexsort((band, text, item))
        item, text, band = item[order], text[order], band[order]
        head = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (band[1:] != band[:-1])])) if len(item) else np.empty(0, np.int64)
        counts = np.diff(np.append(head, len(item)))
        item, text, band = item[head], text[head], band[head]
        # two halves make a band; a half that has no right neighbour stands alone
        joined = np.concatenate([(item[1:] == item[:-1]) & (text[1:] == text[:-1]) & (band[1:] == band[:-1] + 1), [False]])
        both = counts + np.where(joined, np.append(counts[1:], 0), 0)[: len(counts)]
        enough = np.flatnonzero(both >= self.need[item])

        def keep(which: np.ndarray, edits: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
            for t, i, n, *found in zip(text[which].tolist(), item[which].tolist(), both[which].tolist(), edits.tolist(), begin.tolist(), end.tolist()):
                if (t, i) not in out or tuple(found) < out[t, i][:3]:
                    out[t, i] = (*found, n)

        # as it stands: all q-grams of the passage are there, and a plain search tells
        rest = np.ones(len(enough), bool)
        for k in np.flatnonzero(both[enough] >= self.size[item[enough]] + 1 - self.q).tolist():
            x = enough[k]
            i, t, e = int(item[x]), int(text[x]), int(self.edits[item[x]])
            begin = max(0, int(band[x]) * (e + 1))
            window, mine = c[at[t] + begin : min(at[t + 1], at[t] + begin + 2 * (e + 1) + int(self.size[i]))].tobytes(), self.chars[i].tobytes()
            place = window.find(mine)
            while place > 0 and place % 4:  # a find between two code points
                place = window.find(mine, place + 1)
            if place >= 0:
                rest[k] = False
                keep(enough[k : k + 1], np.zeros(1, np.int64), np.array([begin + place // 4]), np.array([begin + place // 4 + int(self.size[i])]))
        enough = enough[rest]
        # bands of several widths side by side; a wider band finds no less
        wide = 1 << np.ceil(np.log2(np.maximum(self.edits[item[enough]], 1))).astype(np.int64)
        wide = np.where(self.edits[item[enough]] == 0, 0, wide)
        for e in np.unique(wide).tolist():
            mine = enough[wide == e]
            mine = mine[np.lexsort((item[mine], band[mine], text[mine]))]
            block = max(1, CELLS // (5 * e + 2))
            for k in range(0, len(mine), block):
                x = mine[k : k + block]
                where = lambda x: (item[x], c, at[text[x]], at[text[x] + 1], band[x] * (self.edits[item[x]] + 1), e)  # noqa: B023, E731
                x = x[align(self, *where(x), places=False)[0]]
                p, cost, begin, end = align(self, *where(x))
                few = cost <= self.edits[item[x[p]]]
                keep(x[p[few]], cost[few], begin[few], end[few])


def by_gram(ids: list, chars: list[np.ndarray], q: int, percent: int) -> list[Passages]:
    """The passages by the longest q-grams, ``q`` at most, of which the lemma
    promises one; a passage without edits may be one q-gram itself."""
    out: dict[int, tuple[list, list[np.ndarray]]] = {}
    for i, c in zip(ids, chars):
        mine = out.setdefault(min(q, len(c) // (len(c) * percent // 100 + 1)), ([], []))
        mine[0].append(i)
        mine[1].append(c)
    return [Passages(*x, k, percent) for k, x in sorted(out.items())]


def blocks_of(benchmark: DataFrame, q: int, percent: int, chars: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The passages in blocks; one block at a time is on the driver."""
    ids, passages, n = [], [], 0
    for r in benchmark.toLocalIterator():
        c, at = code_points([r.text])
        c = c[:-1] if len(c) and c[-1] == 32 else c
        if len(c) < len(c) * percent // 100 + 1:  # empty, or nothing of it needs to be left
            continue
        ids.append(r.item_id)
        passages.append(c)
        n += len(c)
        if n >= chars:
            yield ids, passages
            ids, passages, n = [], [], 0
    if ids:
        yield ids, passages


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, percent: int = EDIT_PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, tie, item_id, edits, begin, end, shared`` for every text that
    holds a passage with at most ``percent`` % of its characters edited; ``tie``
    is a hash of the text, to tell rows with one identifier apart.

    Texts and passages are lower-cased and white space is made single spaces;
    ``begin`` and ``end`` are places in that form. Of several places in a text
    the one with the fewest edits counts, then the first. Passages for which
    the lemma promises no shared q-gram (fewer than 24 characters, at these
    settings) are searched by shorter ones. Null and empty texts and passages
    hold nothing and match nothing. Repeated rows and repeated passages are reported each; null
    identifiers stay null. Other columns are not read.
    """
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tie"), F.lower(F.col("text").cast("string")).alias("text"))
    items = pick(benchmark, item_id=item_col, text=item_text_col).select(F.col("item_id").cast("bigint"), F.lower(F.col("text").cast("string")).alias("text")).filter("text is not null")
    schema = "doc_id bigint, tie bigint, item_id bigint, edits int, begin bigint, end bigint, shared bigint"

    out_dir = fresh_dir(docs.sparkSession, "passages")

    def scan(place: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = kept("decontaminate")
            if place not in mine:  # one block at a time in this worker
                mine.clear()
                fs, path = filesystem(place)
                with fs.open_input_stream(path) as f:
                    mine[place] = by_gram(*pickle.loads(f.read()), q, percent)
            for batch in slices(batches, "text", 6_000_000):
                names, ties, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
                chars = code_points(texts(batch, "text"))
                for sized in mine[place]:
                    for (t, i), found in sized.find(*chars).items():
                        rows.append((names[t], ties[t], sized.ids[i], *found))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "tie", "item_id", "edits", "begin", "end", "shared"])

        return docs.mapInArrow(run, schema)

    found = []
    for n, block in enumerate(blocks_of(items, q, percent, block_chars)):
        found.append(scan(f"{out_dir}/block-{n}"))
        fs, path = filesystem(f"{out_dir}/block-{n}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(pickle.dumps(block))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)
