"""N-gram Jaccard join: near-duplicate groups through a prefix tree.

1. Every text becomes its set of word n-gram fingerprints. Equal sets form one
   class; only classes are compared.
2. The n-grams have one global order, that of their fingerprints, in the sets
   and in the tree. Two sets as
   similar as asked have l n-grams in common among the first ``size -
   ceil(t * size) + l`` of each. Counted over all classes, these beginnings give
   a second order, rare n-grams first, in which each beginning but its last
   l - 1 must still share one n-gram with the other (l for the smallest set that
   could match). What most texts have in common, a passage or a line, goes last
   and drops out, and with it the classes that share nothing else.
3. Classes that share one of the n-grams left meet under the group's smallest
   one, the pivot. Each pair that can link has a pivot in common. Large groups
   are cut into blocks. Where links are not counted, a block's sets are first
   compared with the pivot's, and only those that don't link with it go on to
   ask all blocks; else pairs of blocks go to tasks.
4. In a task the sets are stored in a prefix tree. A probe walks down it; the
   overlap of a shared beginning is counted once, and a subtree is left when the
   probe's items behind the path, or those that the longest set below still has,
   can't make up the overlap it needs. A task
   returns a spanning forest of its links, not all pairs, and how many links
   each set has; a pair that meets in several tasks counts under its first pivot.
5. Smallest labels travel along the links, with shortcuts, until all agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, pick, settle, slices
from .flags import flag, flagged, load_flags
from .packed import _pack, _split, _unpack
from .recompression import NO_ID, _delta, _doc_bucket, _Docs
from .words import mix, range_hash, words

GRAM, NUM, DEN = 5, 75, 100
#: N-grams of the sets in one block, and in all sets for each group of a dealing.
BLOCK, PART_GRAMS = 2_000_000, 5_000_000
#: Pivots with several blocks that are sent to the workers; more are joined.
SENT_PIVOTS = 100_000


def gram_sets(batch: pa.RecordBatch, gram: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-grams of each text; a shorter text is one whole."""
    found, at = words(batch.column(batch.schema.get_field_index("text")), lower=True)
    of = range_hash(found)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if a == b:
            yield np.empty(0, np.uint64)
        elif b - a <= gram:
            yield of(np.array([a]), np.array([b]))
        else:
            begin = np.arange(a, b - gram + 1)
            yield np.unique(of(begin, begin + gram))


def set_print(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a, b = mix(grams).sum(dtype=np.uint64), mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def prefix_size(n: int, num: int, den: int, common: int) -> int:
    """So many first elements of sets as similar as asked have ``common`` in common."""
    return min(n, n - -(-num * n // den) + common)


def proof_size(n: int, num: int, den: int) -> int:
    """How many common n-grams the longer beginning of a set of ``n`` holds: as
    many as the set may miss."""
    return max(1, min(n - -(-num * n // den), -(-num * n // den)))


# ---- the prefix tree


class Tree:
    """Sets as paths of item numbers, ascending in the one order of all n-grams;
    chains without a branch are one node. Items of node k: flat[begin[k]:end[k]]."""

    def __init__(self, sets: list[np.ndarray]):
        self.visited = 0
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.parent, self.begin, self.end, self.depth, self.ends_here, self.kids = [-1], [0], [0], [0], [[]], [[]]
        flat, at, path, last = [], 0, [0], np.empty(0, np.int64)
        for k in order:
            s = sets[k]
            n = min(len(s), len(last))
            differ = np.flatnonzero(s[:n] != last[:n])
            shared = int(differ[0]) if len(differ) else n
            while self.depth[path[-1]] > shared and self.depth[self.parent[path[-1]]] >= shared:
                path.pop()
            top = path[-1]
            if self.depth[top] > shared:  # cut the node in two
                cut = self.end[top] - (self.depth[top] - shared)
                low = self._node(top, cut, self.end[top], self.depth[top])
                self.kids[low], self.ends_here[low] = self.kids[top], self.ends_here[top]
                for c in self.kids[low]:
                    self.parent[c] = low
                self.end[top], self.depth[top], self.kids[top], self.ends_here[top] = cut, shared, [low], []
            if len(s) > shared:
                flat.append(s[shared:])
                node = self._node(path[-1], at, at + len(s) - shared, len(s))
                self.kids[path[-1]].append(node)
                at += len(s) - shared
                path.append(node)
            self.ends_here[path[-1]].append(k)
            last = s
        self.flat = np.concatenate(flat) if flat else np.empty(0, np.int64)
        # sizes of the sets below each node, for the length bounds
        self.least, self.most = [1 << 60] * len(self.parent), [0] * len(self.parent)
        for node in sorted(range(len(self.parent)), key=lambda x: -self.depth[x]):
            if self.ends_here[node]:
                self.least[node], self.most[node] = min(self.least[node], self.depth[node]), max(self.most[node], self.depth[node])
            if (up := self.parent[node]) >= 0:
                self.least[up], self.most[up] = min(self.least[up], self.least[node]), max(self.most[up], self.most[node])

    def _node(self, parent: int, begin: int, end: int, depth: int) -> int:
        for col, v in ((self.parent, parent), (self.begin, begin), (self.end, end), (self.depth, depth), (self.ends_here, []), (self.kids, [])):
            col.append(v)
        return len(self.parent) - 1

    def probe(self, items: np.ndarray, inside: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
        """(set, overlap) of the sets as similar to the probe as asked. ``items``
        are the probe's, ascending; ``inside`` marks them. ``visited`` counts
        the nodes whose items were looked at."""
        size = len(items)
        stack = [(0, 0, size)]
        while stack:
            node, have, left = stack.pop()
            if self.least[node] * num > size * den or self.most[node] * den < size * num:
                continue
            # overlap * (num + den) >= num * (size + other size), least for the smallest set below; what
            # can still match are the probe's items behind the path, and the items from here to the largest set's end
            need, a, b = num * (size + self.least[node]), self.begin[node], self.end[node]
            if (have + min(left, self.most[node] - self.depth[node] + b - a)) * (num + den) < need:
                continue
            self.visited += 1
            if a < b:
                have += int(np.count_nonzero(inside[self.flat[a:b]]))
                left = size - int(np.searchsorted(items, self.flat[b - 1], "right"))
                if (have + min(left, self.most[node] - self.depth[node])) * (num + den) < need:
                    continue
            for k in self.ends_here[node]:
                if have * (num + den) >= num * (size + self.depth[node]):
                    yield k, have
            stack += [(c, have, left) for c in self.kids[node]]


def tree_links(sets: list[np.ndarray], side: list[int] | None, num: int, den: int, earlier: list[frozenset] | None = None, degree: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets`` (with ``side``: between
    those of side 0, kept in the tree, and the probes of side 1). ``degree``
    takes up the number of links of each set, but for those of two sets that
    have one of ``earlier`` in common."""
    vocab, number = np.unique(np.concatenate(sets), return_inverse=True)  # numbers follow the order of the n-grams
    ends = np.cumsum([0, *map(len, sets)])
    paths = [number[a:b] for a, b in zip(ends, ends[1:])]
    stored = [k for k in range(len(sets)) if side is None or side[k] == 0]
    tree, inside = Tree([paths[k] for k in stored]), np.zeros(len(vocab), bool)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for k in range(len(sets)):
        if side is not None and side[k] == 0:
            continue
        inside[paths[k]] = True
        for other, _ in tree.probe(paths[k], inside, num, den):
            o = stored[other]
            if degree is not None and (o < k or side is not None) and (earlier is None or earlier[k].isdisjoint(earlier[o])):
                degree[k] += 1
                degree[o] += 1
            a, b = find(k), find(o)
            if a != b:
                root[max(a, b)] = min(a, b)
        inside[paths[k]] = False
    for k in range(len(sets)):
        if (a := find(k)) != k:
            links.append((a, k))
    return links


# ---- Spark


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, num: int = NUM, den: int = DEN, count_links: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, tie`` (a hash of its text), ``n_shingles,
    component_id, component_tie`` (the first member), ``class_1, class_2``
    and, with ``count_links``, ``class_id`` (the first member of its class, the
    texts with its set) and ``n_links`` (how many other classes its class links
    with).

    A-Z are folded; a set holds the distinct ``gram``-word shingles; a text of
    fewer words is one shingle. Two rows link where ``den * |A & B| >= num *
    |A | B|``. ``component_id`` is the smallest identifier that links reach.
    Null, empty and wordless texts have empty sets and link with nothing. Equal
    texts, repeated rows too, link. A null identifier counts as the smallest
    and gives a null component. Other columns are not read.
    """
    spark = df.sparkSession
    out_dir = fresh_dir(spark, "jaccard")
    rows = pick(df, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("tie", F.xxhash64("text"))

    # sets in outline
    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            info = [(*set_print(g), len(g)) for g in gram_sets(batch, gram)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in zip(*info))], names=["doc_id", "doc", "tie", "class_1", "class_2", "n"])

    docs = settle(rows.select("doc_id", "doc", "tie", "text").mapInArrow(outline, "doc_id bigint, doc bigint, tie bigint, class_1 bigint, class_2 bigint, n bigint"), "outline")
    classes = settle(docs.filter("n > 0").groupBy("class_1", "class_2").agg(F.min(F.struct("doc", "tie")).alias("first"), F.first("n").alias("n")), "classes")
    n_out = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(docs.agg(F.sum("n")).first()[0] or 0) // PART_GRAMS), 1)

    # beginnings
    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held, prints):
            sizes = [len(g) for g in held]
            grams, idx = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
            a, b, n = (np.array(x, np.int64) for x in zip(*prints))
            got = []
            for k, x in _split((mix(grams) % np.uint64(n_out)).astype(np.int64), n_out):
                used, own = np.unique(idx[x], return_inverse=True)
                got.append((k, _pack(a[used], b[used], n[used].astype("<i4"), _delta(own), grams[x])))
            return pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in got], pa.int32()), "blob": pa.array([x for _, x in got], pa.binary())})

        held, prints, n = [], [], 0
        for batch in slices(batches, "text"):
            for grams in gram_sets(batch, gram):
                if len(grams):
                    held.append(grams[: prefix_size(len(grams), num, den, proof_size(len(grams), num, den))])
                    prints.append((*set_print(grams), len(grams)))
                    n += len(held[-1])
            if n > 2_000_000:
                yield flush(held, prints)
                held, prints, n = [], [], 0
        if n:
            yield flush(held, prints)

    def stars(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, "<i8", "<i8", "<i4", "<i4", "<u8") for b in table.column("blob").to_pylist()]
        number, at, own = _Docs([(p[0], p[1]) for p in parts]), 0, []
        size = np.empty(len(number.doc), np.int64)
        for p in parts:
            own.append(number.number[at + np.cumsum(p[3], dtype=np.int64)])
            size[number.number[at : at + len(p[0])]] = p[2]
            at += len(p[0])
        own, grams = np.concatenate(own), np.concatenate([p[4] for p in parts])
        order = np.lexsort((own, grams))
        own, grams = own[order], grams[order]
        once = np.concatenate([[True], (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])])  # equal sets are one class
        own, grams = own[once], grams[once]
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        shared = ~(new & np.append(new[1:], True))
        own, grams = own[shared], grams[shared]
        if not len(own):
            return pa.table({"part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        times = np.diff(np.append(head, len(own)))
        times = np.repeat(times, times)
        got = []
        for k, x in _split(_doc_bucket(number.doc, number.tie, n_out)[own], n_out):
            x = x[np.argsort(own[x], kind="stable")]
            used, mine = np.unique(own[x], return_inverse=True)
            got.append((k, _pack(number.doc[used], number.tie[used], size[used].astype("<i4"), _delta(mine), grams[x], times[x].astype("<i4"))))
        return pa.table({"part": pa.array([k for k, _ in got], pa.int32()), "blob": pa.array([b for _, b in got], pa.binary())})

    def numbered(parts: list[list[np.ndarray]], idx: int) -> tuple[_Docs, np.ndarray]:
        """The classes of several packed tables, and the class of each posting."""
        number, at, own = _Docs([(p[0], p[1]) for p in parts]), 0, []
        for p in parts:
            own.append(number.number[at + np.cumsum(p[idx], dtype=np.int64)])
            at += len(p[0])
        return number, np.concatenate(own)

    def choose(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, "<i8", "<i8", "<i4", "<i4", "<u8", "<i4") for b in table.column("blob").to_pylist()]
        number, own = numbered(parts, 3)
        size = np.empty(len(number.doc), np.int64)
        size[number.number] = np.concatenate([p[2] for p in parts])
        grams, times = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        order = np.lexsort((grams, times, own))
        own, grams = own[order], grams[order]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(head, len(own)))
        # the smallest set that is as similar as asked shows the least
        show = np.array([proof_size(-(-num * x // den), num, den) for x in size[own[head]].tolist()])
        keep = np.arange(len(own)) - np.repeat(head, count) < np.repeat(count - show + 1, count)
        own, grams = own[keep], grams[keep]
        got = []
        for k, x in _split((mix(grams) % np.uint64(n_out)).astype(np.int64), n_out):
            used, mine = np.unique(own[x], return_inverse=True)
            got.append((k, _pack(number.doc[used], number.tie[used], _delta(mine), grams[x])))
        return pa.table({"part": pa.array([k for k, _ in got], pa.int32()), "blob": pa.array([b for _, b in got], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, "<i8", "<i8", "<i4", "<u8") for b in table.column("blob").to_pylist()]
        number, own = numbered(parts, 2)
        grams = np.concatenate([p[3] for p in parts])
        order = np.lexsort((own, grams))
        own, grams = own[order], grams[order]
        head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        pivot = np.repeat(own[head], np.diff(np.append(head, len(own))))
        pair = np.unique((pivot[pivot != own] << 32) | own[pivot != own])
        p, c = pair >> 32, pair & 0xFFFFFFFF
        # the same pair comes from several parts: meet by pair
        key = (mix(number.doc[p].astype(np.uint64) ^ mix(number.doc[c].astype(np.uint64))) % np.uint64(n_out)).astype(np.int64)
        got = [(k, _pack(*(a[i[x]] for i in (p, c) for a in (number.doc, number.tie)))) for k, x in _split(key, n_out)]
        return pa.table({"part": pa.array([k for k, _ in got], pa.int32()), "blob": pa.array([b for _, b in got], pa.binary())})

    def unique_pairs(table: pa.Table) -> pa.Table:
        cols = [np.concatenate(x) for x in zip(*(_unpack(b, "<i8", "<i8", "<i8", "<i8") for b in table.column("blob").to_pylist()))]
        order = np.lexsort(cols)
        cols = [c[order] for c in cols]
        keep = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        return pa.table(dict(zip(("p1", "p2", "class_1", "class_2"), (c[keep] for c in cols))))

    packed = "part int, blob binary"
    begun = rows.select("text").mapInArrow(beginnings, packed)
    for step in (stars, choose, meet):
        begun = begun.repartition(n_out, "part").groupBy("part").applyInArrow(step, packed)
    pairs = settle(begun.repartition(n_out, "part").groupBy("part").applyInArrow(unique_pairs, "p1 bigint, p2 bigint, class_1 bigint, class_2 bigint"), "pairs")
    member = pairs.union(pairs.select("p1", "p2", F.col("p1").alias("class_1"), F.col("p2").alias("class_2")).distinct()).join(classes, ["class_1", "class_2"])
    large = settle(member.groupBy("p1", "p2").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "blocks")
    large = F.broadcast(large) if large.count() <= SENT_PIVOTS else large
    member = settle(member.join(large, ["p1", "p2"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "members")

    # the sets of the members, from the first document of each class
    wanted = member.select(F.col("first.doc").alias("doc"), F.col("first.tie").alias("tie")).distinct()
    seen = flag(wanted, out_dir)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if seen is None else load_flags("jaccard", seen)
        for batch in slices(batches, "text"):
            hit = np.arange(batch.num_rows) if seen is None else np.flatnonzero(flagged(table, batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if len(hit):
                part = batch.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g.tobytes() for g in gram_sets(part, gram)], pa.binary())], names=["doc", "tie", "grams"])

    def with_pivot(table: pa.Table) -> pa.Table:
        """The members of a block, with the pivot where they link with it."""
        mine = table.column("is_pivot").to_numpy()
        pivot = np.frombuffer(table.column("grams")[int(np.flatnonzero(mine)[0])].as_py(), np.uint64)
        doc, tie = (table.column(x).to_numpy()[mine][0] for x in ("doc", "tie"))
        table = table.filter(pa.array(~mine))
        links = np.zeros(table.num_rows, bool)
        for k, grams in enumerate(np.frombuffer(b, np.uint64) for b in table.column("grams").to_pylist()):
            shared = np.count_nonzero(pivot[np.minimum(np.searchsorted(pivot, grams), len(pivot) - 1)] == grams)
            links[k] = shared * (num + den) >= num * (len(pivot) + len(grams))
        out = table.select(["p1", "p2", "own", "doc", "tie", "n", "blocks"])
        return out.append_column("u_doc", pa.array(np.full(len(links), doc), mask=~links)).append_column("u_tie", pa.array(np.full(len(links), tie), mask=~links))

    first_rows = rows.select("doc", "tie", "text") if seen else rows.select("doc", "tie", "text").join(wanted, ["doc", "tie"], "left_semi")
    sets = first_rows.mapInArrow(sets_of, "doc bigint, tie bigint, grams binary").groupBy("doc", "tie").agg(F.first("grams").alias("grams"))
    member = member.withColumn("own", F.pmod(F.xxhash64("class_1", "class_2"), F.col("blocks")).cast("int")).withColumns({"doc": F.col("first.doc"), "tie": F.col("first.tie")})
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    to_pivot = None
    if count_links:
        # the pivots of a class that come before the one it meets others under
        pivot = F.unhex(F.concat(F.lpad(F.hex("p1"), 16, "0"), F.lpad(F.hex("p2"), 16, "0")))
        several = member.select("class_1", "class_2", pivot.alias("pivot")).groupBy("class_1", "class_2").agg(F.collect_set("pivot").alias("pivots")).filter(F.size("pivots") > 1)
        member = member.join(several, ["class_1", "class_2"], "left").withColumn("earlier", F.filter("pivots", lambda x: x < pivot)).drop("pivots")
        dealt = member.select("p1", "p2", "doc", "tie", "earlier", "own", every(F.col("blocks")).alias("other"))
        side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") > F.col("other"), 1).otherwise(0)
        dealt = dealt.select("p1", "p2", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "doc", "tie", "earlier")
    else:
        # in groups of several blocks all are compared with the pivot; only those that don't link with it meet all the others
        none, is_pivot = F.lit(None).cast("array<binary>").alias("earlier"), (F.col("class_1") == F.col("p1")) & (F.col("class_2") == F.col("p2"))
        dealt = member.filter("blocks = 1").select("p1", "p2", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"), "doc", "tie", none)
        large = member.filter("blocks > 1")
        if not large.isEmpty():
            sets = settle(sets, "sets")
            meet_pivot = large.filter(~is_pivot).select("p1", "p2", "own", "doc", "tie", "n", "blocks", F.lit(False).alias("is_pivot"))
            meet_pivot = meet_pivot.union(large.filter(is_pivot).select("p1", "p2", every(F.col("blocks")).alias("own"), "doc", "tie", "n", "blocks", F.lit(True)))
            to_pivot = settle(meet_pivot.join(sets, ["doc", "tie"]).groupBy("p1", "p2", "own").applyInArrow(with_pivot, "p1 bigint, p2 bigint, own int, doc bigint, tie bigint, n bigint, blocks int, u_doc bigint, u_tie bigint"), "pivots")
            apart = to_pivot.filter("u_doc is null")
            probes = apart.groupBy("p1", "p2").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("probes"))
            stored = to_pivot.join(probes, ["p1", "p2"]).select("p1", "p2", F.col("own").alias("i"), every(F.col("probes")).alias("j"), F.lit(0).alias("side"), "doc", "tie", none)
            asking = apart.join(probes, ["p1", "p2"]).select("p1", "p2", every(F.col("blocks")).alias("i"), F.pmod(F.xxhash64("doc", "tie", F.lit(1)), F.col("probes")).cast("int").alias("j"), F.lit(1).alias("side"), "doc", "tie", none)
            dealt = dealt.union(stored).union(asking)

    def join(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(b, np.uint64) for b in table.column("grams").to_pylist()]
        side = table.column("side").to_pylist() if table.column("side")[0].as_py() >= 0 else None
        doc, tie = table.column("doc").to_numpy(), table.column("tie").to_numpy()
        degree = np.zeros(len(found), np.int64)
        known = ([frozenset(x or ()) for x in table.column("earlier").to_pylist()], degree) if count_links else ()
        pairs = np.array(tree_links(found, side, num, den, *known), np.int64).reshape(-1, 2)
        # links of the forest, and a row from each linked set to itself with its number of links
        own = np.flatnonzero(degree)
        a, b = np.append(pairs[:, 0], own), np.append(pairs[:, 1], own)
        return pa.table({"u_doc": doc[a], "u_tie": tie[a], "v_doc": doc[b], "v_tie": tie[b], "n_links": np.append(np.zeros(len(pairs), np.int64), degree[own])})

    met = settle(dealt.join(sets, ["doc", "tie"]).groupBy("p1", "p2", "i", "j").applyInArrow(join, "u_doc bigint, u_tie bigint, v_doc bigint, v_tie bigint, n_links bigint"), "links")
    links = met.filter("n_links = 0")
    if to_pivot is not None:
        links = links.unionByName(to_pivot.filter("u_doc is not null").select("u_doc", "u_tie", F.col("doc").alias("v_doc"), F.col("tie").alias("v_tie"), F.lit(0).cast("bigint").alias("n_links")))
    counted = met.filter("n_links > 0").groupBy(F.struct(F.col("u_doc").alias("doc"), F.col("u_tie").alias("tie")).alias("node")).agg(F.sum("n_links").alias("n_links"))
    label = components(links.select(F.struct(F.col("u_doc").alias("doc"), F.col("u_tie").alias("tie")).alias("u"), F.struct(F.col("v_doc").alias("doc"), F.col("v_tie").alias("tie")).alias("v")))
    named = settle(classes.withColumnRenamed("first", "node").join(label, "node", "left").join(counted, "node", "left").select("class_1", "class_2", F.coalesce("label", "node").alias("component"), "n_links", F.col("node.doc").alias("class_doc")), "named")
    result = docs.join(named, ["class_1", "class_2"], "left").withColumn("class_doc", F.when(F.col("n") > 0, F.col("class_doc"))).withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.struct("doc", "tie")))
    first = F.coalesce("class_doc", "doc")
    links = [F.when(first != NO_ID, first).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")] if count_links else []
    return result.select(
        "doc_id", "tie", F.col("n").alias("n_shingles"), F.when(F.col("component.doc") != NO_ID, F.col("component.doc")).alias("component_id"), F.col("component.tie").alias("component_tie"),
        "class_1", "class_2", *links,
    )


def components(links: DataFrame) -> DataFrame:
    """``node, label``: for every node of the links ``u, v`` the
    smallest node it reaches. Each round takes the smallest label of the
    neighbours, then the label of that label; rounds go on until none changes."""
    both = settle(links.union(links.select("v", "u")).distinct().toDF("node", "to"), "edges")
    label = both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("label"))
    label = settle(label, "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        far = step.select(F.col("node").alias("new"), F.col("new").alias("further"))
        step = settle(step.join(far, "new", "left").select("node", "label", F.least("new", F.coalesce("further", "new")).alias("new")), "labels")
        done = step.filter("new != label").isEmpty()
        label = step.select("node", F.col("new").alias("label"))
        if done:
            return label
