"""BPE encoding and decoding with tree concatenation.

A text is halved, and its halves again, down to leaves of at most ``leaf``
characters, wherever the cuts may fall. The leaves are encoded on their own, and
the results are concatenated up the tree. At each join a window of tokens around
the seam is encoded anew and grows until it agrees with both sides; then the
concatenation equals the encoding of the whole. The leaves of very long texts
are encoded by the library's threads; other leaves repeat their words a lot, so
each worker keeps a bounded table from piece (white space and what follows) to
ids.

Why that is exact: the pre-tokenizer is certain to cut where white space follows
something else, and what comes after such a place has no influence on what comes
before, nor the other way round. So a window agrees with a side if their outer
tokens are equal up to such a place and beyond. In stretches without white space
the tokens are the BPE encoding of their text iff every adjacent pair is the
encoding of the pair's text: pairs inside a side and pairs inside the window are
valid by construction, and where the window equals a side in its outer tokens,
so are the pairs across its edges. A window that reaches the end of a side
agrees with it.

The pre-tokenizers that this holds for are stated below; with a tokenizer file
of any other kind, whole texts go to the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept, pick, slices, texts

#: White space of Unicode, stated as fixed values.
_WS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORDS = re.compile(f"[^{_WS}]+")
_PIECES = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: One pre-token for sure, and not changed by NFC: an optional space and letters of Latin-1.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_LATIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]+").fullmatch
_ENDS = re.compile(r".*[A-Za-zÀ-ÖØ-öø-ÿ][.,;!?]", re.S).fullmatch
#: The pre-tokenizers that pieces and trees are right for.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORD_LEVEL = [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
_WORD_CHANGES = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Pieces of more characters are not remembered; texts of more have their leaves encoded by threads.
LONGEST_PIECE, WIDE = 128, 1 << 20
#: What a remembered piece takes besides its characters and ids.
_ENTRY = 200
_PACKERS = [struct.Struct(f"<{n}i").pack for n in range(16)]
#: Tokens that must agree without white space; tokens of a side in the first window.
AGREE, FIRST = 2, 8


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_table() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes follow from code point 256 in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in set(keep)):
        table[chr(256 + n)] = b
    return table


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}i", *ids)


_SPELL = {b: c for c, b in byte_table().items()}


def kind_of(config: dict) -> str | None:
    """"bytes" or "words" for tokenizer files whose cuts are known, else None."""
    model, without = config["model"], lambda x: {k: v for k, v in x.items() if k != "trim_offsets"}
    usual = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    added = config["added_tokens"]
    if not usual or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(_WORDS.fullmatch(t["content"]) is None for t in added):
        return None
    pre, normalizer = config["pre_tokenizer"] or {}, config["normalizer"]
    if without(pre) == _BYTE_LEVEL and normalizer is None and not model.get("end_of_word_suffix"):
        return "bytes"
    if pre.get("type") == "Sequence" and [without(x) for x in pre["pretokenizers"]] == _WORD_LEVEL and (normalizer or {}).get("normalizers") == _WORD_CHANGES:
        return "words"
    return None


class Codec:
    """Encoder and decoder for one tokenizer file, with a bounded piece table.

    ``table_bytes`` bounds what the remembered pieces take: a full table becomes
    the older one, whose pieces move back when they are met, and the older one
    goes. ``joins`` and ``windows`` count the seams of the trees and what was
    encoded anew for them.
    """

    def __init__(self, path: str, leaf: int = 1024, table_bytes: int = 48_000_000):
        self.tok = load_tokenizer(path)
        self.leaf, self.limit, self.held, self.known, self.older = leaf, table_bytes, 0, {}, {}
        self.joins = self.windows = 0
        alphabet, config = byte_table(), json.loads(self.tok.to_str())
        self.kind = kind_of(config)
        self.folds = self.kind == "words"
        #: The model alone, for pieces that are one normalised pre-token.
        plain = config | {"normalizer": None, "pre_tokenizer": None, "post_processor": None}
        self.plain, self.alone, self.bare, self.is_end = plain, None, None, None
        if suffix := config["model"].get("end_of_word_suffix"):
            self.bare = type(self.tok).from_str(json.dumps(plain | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))
            self.is_end = np.zeros(self.tok.get_vocab_size(), bool)
            self.is_end[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.cut = _split_words if self.kind == "words" else _PIECES.findall
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            if all(c in alphabet for c in token):
                self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        #: Tokens that begin with white space, and that end with something else; plain ASCII only.
        n = max(self.bytes_of, default=-1) + 1
        raw = [self.bytes_of.get(i, b"") for i in range(n)]
        self.opens = bytes(x[:1] in (b" ", b"\t", b"\n", b"\r") and i not in self.special.values() for i, x in enumerate(raw))
        self.closes = bytes(b" " < x[-1:] < b"\x7f" and i not in self.special.values() for i, x in enumerate(raw))

    # ---- encoding
    def encode_plain(self, many: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(many, add_special_tokens=False)]

    def encode_tree(self, text: str) -> np.ndarray:
        """Ids of a whole text by tree concatenation, equal to those of the
        tokenizers library."""
        if self.kind != "bytes":
            return self.encode(text)
        if self._cut is None or not any(x in text for x in self.special):
            return np.frombuffer(self._tree(text), "<i4")
        out = [_packed([self.special[x]]) if x in self.special else self._tree(x) for x in self._cut.split(text)]
        return np.frombuffer(b"".join(out), "<i4")

    def _tree(self, text: str) -> bytes:
        if len(text) <= self.leaf:
            return self._pieces(text)
        cuts = [0, len(text)]
        while any(b - a > self.leaf for a, b in zip(cuts, cuts[1:])):
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]) if b - a > self.leaf)})
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        parts = [_packed(x) for x in self._side_by_side(leaves)] if len(text) > WIDE else list(map(self._pieces, leaves))
        while len(parts) > 1:
            joined = [self._join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0]

    def _side_by_side(self, leaves: list[str]) -> list[list[int]]:
        """The leaves of a very long text, by the library's threads."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        try:
            return self.encode_plain(leaves)
        finally:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def _join(self, left: bytes, right: bytes) -> bytes:
        self.joins += 1
        n, m, grow = len(left) // 4, len(right) // 4, FIRST
        while True:
            self.windows += 1
            a, b = min(grow, n), min(grow, m)
            tail, head = np.frombuffer(left, "<i4", a, 4 * (n - a)).tolist(), np.frombuffer(right, "<i4", b).tolist()
            try:
                window = b"".join([self.bytes_of[i] for i in tail + head]).decode()
            except UnicodeDecodeError:
                window = None  # an edge inside a character: grow
            if window is not None:
                packed = self._pieces(window)
                ids, bare = np.frombuffer(packed, "<i4").tolist(), _WORDS.fullmatch(window) is not None and window[0] != "'"
                if (a == n or self._agrees(ids, tail, bare)) and (b == m or self._agrees_after(ids, head, bare)):
                    return left[: 4 * (n - a)] + packed + right[4 * b :]
            grow *= 2

    def _agrees(self, ids: list[int], side: list[int], bare: bool) -> bool:
        """Whether the window equals the left side in its first tokens, up to a
        certain cut; in a ``bare`` window, without white space, in some tokens."""
        for k in range(min(len(ids) - 1, len(side))):
            if ids[k] != side[k]:
                return bare and k >= AGREE
            if self.closes[ids[k]] and self.opens[ids[k + 1]]:
                return True
        return bare and len(side) > AGREE and len(ids) > AGREE

    def _agrees_after(self, ids: list[int], side: list[int], bare: bool) -> bool:
        """The same for the right side, from the last token on."""
        for k in range(1, min(len(ids) - 1, len(side)) + 1):
            if ids[-k] != side[-k]:
                return bare and k > AGREE
            if self.opens[ids[-k]] and self.closes[ids[-k - 1]]:
                return True
        return bare and len(side) > AGREE and len(ids) > AGREE

    def learn(self, pieces: set[str]) -> None:
        """Put pieces of at most ``LONGEST_PIECE`` characters into the young table."""
        if self.held > self.limit:
            self.older, self.known, self.held = self.known, {}, 0
        known, older, n_known = self.known, self.older, len(self.known)
        plain, other, whole = {}, set(), []
        folds, n_older = self.folds, len(older)
        for p in pieces:
            if n_older and (ids := older.get(p)) is not None:
                known[p] = ids
                continue
            if p.isascii() and (core := p[:-1] if p[-1] in ".,;!?" else p).isalpha():  # the common case
                x = core.lower() if folds else core
                if x not in known:
                    plain[x] = None
                if x is not p:
                    if core is p:
                        whole.append((p, (x,)))
                    else:
                        whole.append((p, (x, p[-1])))
                        if p[-1] not in known:
                            other.add(p[-1])
                continue
            q = p.lower() if self.folds and _LATIN(p) else p
            parts = (q,)
            if _ENDS(q):  # the pre-tokenizer cuts between a letter and these marks
                parts = (q[:-1], q[-1])
            if q[0] == "\n" and _PLAIN(parts[0][1:]):  # and after a line feed that precedes a letter
                parts = ("\n", parts[0][1:], *parts[1:])
            for x in parts:
                if x not in known:
                    if (ids := older.get(x)) is not None:
                        known[x] = ids
                    elif _PLAIN(x):
                        plain[x] = None
                    else:
                        other.add(x)
            if parts[0] is not p:
                whole.append((p, parts))
        other = list(other)
        known.update(zip(other, map(_packed, self.encode_plain(other))))
        if plain:
            known.update(zip(plain, self._encode_bare([x if x.isascii() and x[0] != " " else x.encode().decode("latin-1").translate(_SPELL) for x in plain])))
        for p, parts in whole:
            known[p] = b"".join([known[x] for x in parts])
        # words share their ids; a piece has at most one for each byte
        self.held += (len(known) - n_known) * _ENTRY + 5 * sum(map(len, pieces))

    def _encode_bare(self, spelt: list[str]) -> list[bytes]:
        """Ids of normalised pre-tokens in byte-level spelling. Where the model
        marks word ends, many go in one call and the marks tell them apart."""
        if self.is_end is not None:
            blocks = [" ".join(spelt[k : k + 128]) for k in range(0, len(spelt), 128)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(blocks, add_special_tokens=False)), "<i4")
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(ends) == len(spelt):
                raw = ids.tobytes()
                return [raw[a:b] for a, b in zip([0, *ends], ends)]
        if self.alone is None:
            self.alone = type(self.tok).from_str(json.dumps(self.plain))
        return [_packed(e.ids) for e in self.alone.encode_batch_fast(spelt, add_special_tokens=False)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text by its pieces, equal to those of the library."""
        return np.frombuffer(self._pieces(text), "<i4")

    def _pieces(self, text: str) -> bytes:
        if self.kind is None:
            return _packed(self.encode_plain([text])[0])
        pieces = self.cut(text)
        got = list(map(self.known.get, pieces))
        if None in got:
            miss = [k for k, g in enumerate(got) if g is None]
            self.learn({p for k in miss if len(p := pieces[k]) <= LONGEST_PIECE})
            for k in miss:
                p = pieces[k]
                got[k] = self.known[p] if len(p) <= LONGEST_PIECE else _packed(self.encode_plain([p])[0])
        return b"".join(got)

    # ---- decoding
    def decode(self, ids) -> str:
        """Text of ids, special tokens kept; broken UTF-8 gives U+FFFD."""
        if self.kind != "bytes":
            return self.tok.decode(list(map(int, ids)), skip_special_tokens=False)
        get = self.bytes_of.__getitem__
        return b"".join(map(get, ids)).decode("utf-8", "replace")


def _split_words(text: str) -> list[str]:
    """The stretches without white space. str.split also splits at four control
    characters that the tokenizers keep."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _WORDS.findall(text)
    return text.split()


def codec(path: str, leaf: int, table_bytes: int) -> Codec:
    """The codec of this worker process: tasks that run in it one after the
    other share the tokenizer and its piece tables."""
    mine, key = kept("bpe"), (path, leaf, table_bytes)
    if key not in mine:
        mine.clear()
        mine[key] = Codec(path, leaf, table_bytes)
    return mine[key]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 1024, table_bytes: int = 48_000_000) -> DataFrame:
    """One row per input row: ``doc_id``, ``ids`` array<int>, ``decoded`` string
    (the decoding of those very ids).

    A null text counts as empty: no ids, empty decoding. A null id stays null.
    Repeated rows give repeated results; an empty table gives an empty one.
    Texts of any length are encoded whole: those over ``leaf`` characters as a
    tree of halves. A worker's table of pieces takes up to twice
    ``table_bytes``. Other columns of the input are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(path, leaf, table_bytes)
        spelling = np.array([mine.bytes_of.get(i, b"") for i in range(max(mine.bytes_of) + 1)], dtype=object)
        for batch in slices(batches, "text", 2_000_000):
            ids = [mine.encode_tree(t) for t in texts(batch, "text")]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.empty(0, "<i4")
            if mine.kind == "bytes":
                back = [b"".join(spelling[x].tolist()).decode("utf-8", "replace") for x in ids]
            else:
                back = [mine.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(back, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return pick(df, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, out)
