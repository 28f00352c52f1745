"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counted in Spark: every task counts its own words and bigrams, tables of counts
are dealt by word fingerprint and merged. A word that holds a large share of all
tokens has its bigrams dealt by both words. The model is stored as shards of
sorted fingerprint arrays with their counts beside them in the shared folder;
workers map the files into memory and look up whole batches by binary search.

For other orders see ``ngram_orders``::

    P(w|v)  = max(c(vw) - D(c), 0) / c(v) + gamma(v) * Pc(w)
    Pc(w)   = max(n(w) - D'(n), 0) / T + gamma' / (V + 1)

c: counts; n(w): different words seen before w; T: different bigrams; V:
different words. D has the three discounts of the modified method, from the
counts of counts, for bigrams and for n(w) each. The last 1/(V + 1) is the
share of one word that was never seen.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, kept, parts_for, pick, slices
from .ngram_orders import OrderModel, order_log10, train_order
from .packed import _pack, _split, _unpack
from .words import mix, words

END, BEGIN = np.uint64(0x0E0D), np.uint64(0xB0D)
_WORD = np.dtype([("count", "<i8"), ("before", "<i8"), ("n1", "<i8"), ("n2", "<i8"), ("n3", "<i8")])


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with an end after each text, whether each begins a text, text
    offsets)."""
    found, at = words(batch.column(batch.schema.get_field_index("text")), lower=True)
    tok = np.insert(found, at[1:], END)
    offsets = at + np.arange(len(at))
    begins = np.zeros(len(tok), bool)
    begins[offsets[:-1]] = True
    return tok, begins, offsets


def numbered(tok: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens with BEGIN at the end, number of each token, number of
    the token before it)."""
    vocab, number = np.unique(tok, return_inverse=True)
    before = np.concatenate([[0], number[:-1]])
    before[begins] = len(vocab)
    return np.append(vocab, BEGIN), number, before


def shard_of(word: np.ndarray, n: int) -> np.ndarray:
    return (mix(word) % np.uint64(n)).astype(np.int64)


def pair_shard(before: np.ndarray, word: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """Bigrams go by their second word; those of hot words by both."""
    key = np.where(np.isin(word, hot), word ^ mix(before), word) if len(hot) else word
    return shard_of(key, n)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return [keys, *values]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[head], *(np.add.reduceat(v[order], head) for v in values)]


def _save(out_dir: str, name: str, *arrays: np.ndarray) -> str:
    place = f"{out_dir}/{name}-{uuid.uuid4().hex}"
    fs, path = filesystem(place)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(np.array([a.nbytes for a in arrays], "<i8").tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    return place


def _mapped(place: str, *kinds) -> list[np.ndarray]:
    """Arrays of a shard, mapped into memory. Where the shared folder is no file
    system of this machine, the worker maps a copy of its own, made once in its
    temporary folder; nobody else reads that, and a lost one is made again."""
    opened = kept("kneser_ney")
    if place not in opened:
        fs, path = filesystem(place)
        if not (place.startswith("file:") or "://" not in place):
            if "copies" not in opened:
                opened["copies"] = tempfile.TemporaryDirectory(prefix="lm-")
            mine = f"{opened['copies'].name}/{path.rsplit('/', 1)[1]}"
            with fs.open_input_stream(path) as source, open(mine, "wb") as out:
                shutil.copyfileobj(source, out, 1 << 22)
            path = mine
        raw = np.memmap(path, np.uint8, "r")
        at, out = 8 * len(kinds), []
        for size, kind in zip(raw[:at].view("<i8").tolist(), kinds):
            out.append(raw[at : at + size].view(kind))
            at += size
        opened[place] = out
    return opened[place]


@dataclass(frozen=True)
class Model:
    """Places of the shards and the few totals; small, whatever the corpus."""

    word_shards: tuple[str, ...]
    pair_shards: tuple[str, ...]
    hot: tuple[int, ...]
    tokens: int
    distinct: int
    texts: int
    bigrams: int
    pair_counts: tuple[int, ...]  # bigrams met 1, 2, 3 and 4 times
    word_counts: tuple[int, ...]  # words after 1, 2, 3 and 4 different words
    begin: tuple[int, int, int]  # bigrams from the start of a text by count 1, 2, 3 and more


def discounts(n: tuple[int, ...]) -> tuple[float, float, float]:
    """The discounts for counts 1, 2 and 3 or more; where counts of counts are
    missing (a tiny corpus) 0.5 each."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.0), k) for k, x in enumerate(d, 1))


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def train(df: DataFrame, out_dir: str, text_col: str = "text", batch_tokens: int = 4_000_000, order: int = 2) -> Model | OrderModel:
    """Count the texts of ``df`` and write the model below ``out_dir``.

    Bigrams are counted here, as packed arrays; other orders, at several times
    the cost, in ``ngram_orders``.

    A null or empty text is an end alone. An empty table gives an empty model.
    """
    if order != 2:
        return train_order(df, out_dir, order, text_col)
    rows = pick(df, text=text_col).selectExpr("cast(text as string) text")
    n_out = parts_for(rows)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            out = [(k, _pack(keys[x], counts[x].astype("<i8"))) for k, x in _split(shard_of(keys, n_out), n_out)]
            return pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

        held, n = [], 0
        for batch in slices(batches, "text"):
            held.append(tokens(batch)[0])
            n += len(held[-1])
            if n > batch_tokens:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    def merge_words(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, "<u8", "<i8") for b in table.column("blob").to_pylist()]
        keys, counts = _sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        part, end = table.column("part")[0].as_py(), np.searchsorted(keys, END)
        top = np.argsort(counts)[-64:]
        return pa.table(
            {
                "part": pa.array([part], pa.int32()), "place": [_save(out_dir, "counts", keys, counts)], "n": [int(counts.sum())], "distinct": [len(keys)],
                "texts": [int(counts[end]) if end < len(keys) and keys[end] == END else 0], "top": pa.array([keys[top].astype(np.int64).tolist()], pa.list_(pa.int64())), "top_n": pa.array([counts[top].tolist()], pa.list_(pa.int64())),
            }
        )

    made = rows.mapInArrow(count_words, "part int, blob binary").repartition(n_out, "part").groupBy("part").applyInArrow(merge_words, "part int, place string, n bigint, distinct bigint, texts bigint, top array<bigint>, top_n array<bigint>").collect()
    total = sum(r.n for r in made)
    distinct, texts = sum(r.distinct for r in made), sum(r.texts for r in made)
    counted = {r.part: r.place for r in made}
    hot = np.array(sorted({k & (1 << 64) - 1 for r in made for k, n in zip(r.top, r.top_n) if n * 8 * n_out > total}), np.uint64)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            vocab, number, before = numbered(*(np.concatenate(x) for x in zip(*held)))
            pair = (number.astype(np.uint64) << np.uint64(32)) | before.astype(np.uint64)
            del number, before
            pair.sort()
            head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            counts = np.diff(np.append(head, len(pair))).astype("<i8")
            w, v = vocab[(pair[head] >> np.uint64(32)).astype(np.int64)], vocab[(pair[head] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            out = [(k, pack_pairs(w[x], v[x], counts[x])) for k, x in _split(pair_shard(v, w, hot, n_out), n_out)]
            return pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

        held, n = [], 0
        for batch in slices(batches, "text"):
            tok, begins, _ = tokens(batch)
            held.append((tok, begins))
            n += len(tok)
            if n > batch_tokens:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    def pack_pairs(w, v, c):
        """By word (ascending): each word once, with how many words precede it."""
        head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        return _pack(w[head], np.diff(np.append(head, len(w))).astype("<i4"), v, c.astype("<i4"))

    def merge_pairs(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, "<u8", "<i4", "<u8", "<i4") for b in table.column("blob").to_pylist()]
        w, v = np.concatenate([np.repeat(p[0], p[1]) for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.lexsort((v, w))
        w, v, c = w[order], v[order], np.concatenate([p[3] for p in parts])[order].astype("<i8")
        head = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])]))
        w, v, c = w[head], v[head], np.add.reduceat(c, head)
        part, key = table.column("part")[0].as_py(), pair_key(v, w)
        by_key = np.argsort(key)
        place = _save(out_dir, "pairs", key[by_key], c[by_key].astype("<i8"))
        after = _sum_by(w, np.ones(len(w), "<i8"))
        ahead = _sum_by(v, *((x.astype("<i8")) for x in (c == 1, c == 2, c > 2)))
        groups, blobs = [], []
        for k, x in _split(shard_of(after[0], n_out), n_out):
            groups.append(k)
            blobs.append(_pack(after[0][x], after[1][x], *(np.zeros(0, "<i8"),) * 4))
        for k, x in _split(shard_of(ahead[0], n_out), n_out):
            groups.append(k)
            blobs.append(_pack(np.zeros(0, "<u8"), np.zeros(0, "<i8"), *(a[x] for a in ahead)))
        info = [part, len(c), *(int((c == k).sum()) for k in (1, 2, 3, 4))]
        n = len(groups)
        return pa.table({"part": pa.array([*groups, -1], pa.int32()), "blob": pa.array([*blobs, b""], pa.binary()), "place": [None] * n + [place], "info": pa.array([None] * n + [info], pa.list_(pa.int64()))})

    def merge_stats(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:  # what the shards say of themselves
            return table.select(["part", "place", "info"])
        parts = [_unpack(b, "<u8", "<i8", "<u8", "<i8", "<i8", "<i8") for b in table.column("blob").to_pylist()]
        keys, counts = _mapped(counted[part], "<u8", "<i8") if part in counted else (np.zeros(0, "<u8"), np.zeros(0, "<i8"))
        rows = np.zeros(len(keys), _WORD)
        rows["count"] = counts
        after = _sum_by(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        rows["before"][np.searchsorted(keys, after[0])] = after[1]
        ahead = _sum_by(*(np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5)))
        start = ahead[0] == BEGIN
        at = np.searchsorted(keys, ahead[0][~start])
        for name, x in zip(("n1", "n2", "n3"), ahead[1:]):
            rows[name][at] = x[~start]
        n = rows["before"]
        info = [part, *(int((n == k).sum()) for k in (1, 2, 3, 4)), *(int(x[start].sum()) for x in ahead[1:])]
        return pa.table({"part": pa.array([part], pa.int32()), "place": [_save(out_dir, "words", keys, rows)], "info": pa.array([info], pa.list_(pa.int64()))})

    pairs = rows.mapInArrow(count_pairs, "part int, blob binary").repartition(n_out, "part").groupBy("part").applyInArrow(merge_pairs, "part int, blob binary, place string, info array<bigint>")
    made = pairs.repartition(n_out, "part").groupBy("part").applyInArrow(merge_stats, "part int, place string, info array<bigint>").collect()
    own = [r for r in made if r.part >= 0]
    shards = [r for r in made if r.part < 0]
    word_at, pair_at = {r.part: r.place for r in own}, {r.info[0]: r.place for r in shards}
    sums = lambda rows, a, b: tuple(sum(r.info[k] for r in rows) for k in range(a, b))
    return Model(
        word_shards=tuple(word_at.get(k, "") for k in range(n_out)),
        pair_shards=tuple(pair_at.get(k, "") for k in range(n_out)),
        hot=tuple(hot.tolist()),
        tokens=total,
        distinct=distinct,
        texts=texts,
        bigrams=sum(r.info[1] for r in shards),
        pair_counts=sums(shards, 2, 6),
        word_counts=sums(own, 1, 5),
        begin=sums(own, 5, 8),
    )


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(before) * np.uint64(0x9FB21C651E98DF25) + word)


def _look_up(place: str, keys: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray] | None:
    """(found, values) of ascending keys in one shard."""
    if not place:
        return None
    have, values = _mapped(place, "<u8", kind)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return have[at] == keys, values[at]


def log10_probabilities(model: Model, tok: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(token | token before), count of the token) for a batch."""
    n_out = len(model.word_shards)
    vocab, w, v = numbered(tok, begins)
    stats = np.zeros(len(vocab), _WORD)
    for k, x in _split(shard_of(vocab[:-1], n_out), n_out):
        if (got := _look_up(model.word_shards[k], vocab[x], _WORD)) is not None:
            stats[x[got[0]]] = got[1][got[0]]
    stats[-1] = (model.texts, 0, *model.begin)
    pair, which = np.unique((w.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64), return_inverse=True)
    pw, pv = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    key, counts = pair_key(vocab[pv], vocab[pw]), np.zeros(len(pair), np.int64)
    known = np.flatnonzero((stats["before"][pw] > 0) & (stats["count"][pv] > 0))
    where = pair_shard(vocab[pv[known]], vocab[pw[known]], np.array(model.hot, np.uint64), n_out)
    for k, x in _split(where, n_out):
        x = known[x]
        x = x[np.argsort(key[x])]
        if (got := _look_up(model.pair_shards[k], key[x], "<i8")) is not None:
            counts[x[got[0]]] = got[1][got[0]]
    # the lower order: how many words precede w
    d_low, total = discounts(model.word_counts), max(1, model.bigrams)
    n1, n2 = model.word_counts[:2]
    left_low = (d_low[0] * n1 + d_low[1] * n2 + d_low[2] * max(0, model.distinct - n1 - n2)) / total if model.bigrams else 1.0
    n = stats["before"]
    low = (n - _discount(n, d_low)) / total + left_low / (model.distinct + 1)
    d, c = discounts(model.pair_counts), stats["count"]
    left = np.where(c > 0, (d[0] * stats["n1"] + d[1] * stats["n2"] + d[2] * stats["n3"]) / np.maximum(c, 1), 1.0)
    p = np.where(c[pv] > 0, (counts - _discount(counts, d)) / np.maximum(c[pv], 1), 0.0) + left[pv] * low[pw]
    return np.log10(p)[which], c[w]


def score(df: DataFrame, model: Model | OrderModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_known, train_tokens,
    base_score, score``.

    ``score`` is the model's log10 probability of the text with its end,
    ``base_score`` that of the add-one unigram model. A-Z are folded. A null or
    empty text is an end alone. Whole texts are scored, of any length; repeated
    rows score alike; a null identifier stays null. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8_000_000):
            tok, begins, at = tokens(batch)
            logs, counts = (order_log10 if isinstance(model, OrderModel) else log10_probabilities)(model, tok, begins)
            base = np.log10((counts + 1) / (model.tokens + model.distinct + 1))
            add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has a token
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(add((counts > 0).astype(np.int64)), pa.int64()), pa.array(np.full(batch.num_rows, model.tokens), pa.int64()), pa.array(add(base)), pa.array(add(logs))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = pick(df, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the identifier as text, modulo 7,
    is 2. A null identifier counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2
