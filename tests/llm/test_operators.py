"""The operators against brute force on small fixtures: nulls, empty and long
texts, ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id bigint, text string, part int, blob string, tie string, doc string, n int, words string"


def vocabulary(n=60, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 7))) for _ in range(n)]


def corpus(seed=0, n=60):
    r, vocab = random.Random(seed), vocabulary(400)
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(4, 15))) + "."
    shared = [line() for _ in range(4)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    out = []
    for k in range(n):
        kind = r.random()
        if kind < 0.25 and out:
            words = r.choice(out).split(" ")
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice(vocab)
            out.append(" ".join(words))
        elif kind < 0.35:
            out.append("\n".join([line(), shared[0], shared[1], shared[2], line()]))
        elif kind < 0.45:
            out.append(line() + " " + passage + " " + line())
        elif kind < 0.5:
            out.append(" ".join(["Te"] * r.randint(1, 60)))
        else:
            out.append("\n".join(r.choice(shared) if r.random() < 0.1 else line() for _ in range(r.randint(1, 9))))
    out += ["", "   \n\t ", "one", "a b c d", "x" * 5000, " ".join(vocab * 8), "café au lait \x1c ok", "A B C D E F", "a b c d e f"]
    return out


def table(spark, texts, extra=()):
    rows = [(k * 3 % 1000, t, 7, "b", "t", "d", 1, "w") for k, t in enumerate(texts)]
    rows += [(k, t, None, None, None, None, None, None) for k, t in extra]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus(), [(5000, None), (10, "repeated row " * 30), (10, "repeated row " * 30)])


@pytest.fixture(scope="module")
def rows(docs):
    return sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: r[0])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- 1


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_line_dedup(docs, rows, nothing, min_lines):
    from vecgrove.llm.line_dedup import dedup_lines

    got, first = by_id(dedup_lines(docs, min_lines=min_lines)), {}
    for i, text in rows:
        lines = (text or "").split("\n")
        at, gone = [k for k, x in enumerate(lines) if WORDS.search(x)], set()
        for a in range(len(at) - min_lines + 1):
            mine = [at[a + j] for j in range(min_lines)]
            if first.setdefault(tuple(lines[x] for x in mine), (i, a)) != (i, a):
                gone |= set(mine)
        assert got[i].cleaned == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert (got[i].n_lines, got[i].n_removed) == (len(lines), len(gone))
        assert (got[i].longest_run >= min_lines) == bool(gone)
    assert dedup_lines(nothing).count() == 0


def test_line_dedup_is_plain_dataframe(docs):
    from vecgrove.llm.line_dedup import dedup_lines

    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_null_id(spark):
    from vecgrove.llm.line_dedup import dedup_lines

    df = spark.createDataFrame([(None, "a\nb"), (1, "a\nb"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.cleaned for r in dedup_lines(df).collect()}
    assert got == {None: "a\nb", 1: "", 2: ""}


def test_longest_run_over_buckets(spark, monkeypatch):
    from vecgrove.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BUCKET_BITS", 1)
    monkeypatch.setattr(line_dedup, "GROUP_BITS", 1)
    lines = [f"line {k}" for k in range(7)]
    df = spark.createDataFrame([(k, "\n".join(lines)) for k in range(5)], "doc_id bigint, text string")
    got = by_id(line_dedup.dedup_lines(df))
    assert got[0].cleaned == "\n".join(lines) and got[0].n_removed == 0
    assert all((got[k].cleaned, got[k].n_removed, got[k].longest_run) == ("", 7, 7) for k in range(1, 5))


@pytest.mark.parametrize("min_lines", [2, 3])
def test_line_dedup_of_long_single_lines(docs, rows, min_lines):
    from vecgrove.llm.line_dedup import dedup_lines

    got, first, lone = by_id(dedup_lines(docs, min_lines=min_lines, long_words=12)), {}, 0
    for i, text in rows:
        lines = (text or "").split("\n")
        at, runs, single = [k for k, x in enumerate(lines) if WORDS.search(x)], set(), set()
        for a in range(len(at) - min_lines + 1):
            mine = [at[a + j] for j in range(min_lines)]
            if first.setdefault(tuple(lines[x] for x in mine), (i, a)) != (i, a):
                runs |= set(mine)
        for k in at:
            if len(WORDS.findall(lines[k])) >= 12 and first.setdefault(lines[k], (i, k)) != (i, k):
                single.add(k)
        gone, lone = runs | single, lone + len(single - runs)
        assert got[i].cleaned == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert (got[i].n_removed, got[i].longest_run > 0) == (len(gone), bool(gone))
    assert lone > 0


# ---- 2


def plain_verdict(line):
    """Whether a line stays, by the rules as they are stated."""
    from vecgrove.llm import quality as q

    n = len(WORDS.findall(line))
    if not n:
        return True
    if line.count("|") > 2 or any(x in line.lower() for x in q.BOILERPLATE) or re.search(q.MENU, line):
        return False
    if not re.search(r"""[.!?…。！？:;]["'”’»)\]]*\s*$""", line) and (n < 12 or not re.search(r"""[.!?]["'”’»)\]]*\s""", line)):
        return False
    return sum(line.count(c) for c in "#*$%&|<>") * 4 <= n and line.count("!!") * 4 <= n


def test_quality_of_labelled_documents(spark):
    """Of the documents that pass the base rules, the clean ones stay and the
    junk goes, in every language."""
    from vecgrove.llm.quality import assess

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    judged = assess(docs, carry=True).filter("not base_failed").join(labels, "doc_id").groupBy("carried.lang", "quality").agg({"kept": "count"}).collect()
    kept = assess(docs, carry=True).filter("kept").join(labels, "doc_id").groupBy("carried.lang", "quality").count().collect()
    n, k = ({(r[0], r[1]): r[2] for r in x} for x in (judged, kept))
    assert {lang for lang, _ in n} == {"en", "de", "fr", "es"}
    for lang in ("en", "de", "fr", "es"):
        assert k[lang, 1] >= 0.98 * n[lang, 1] and k.get((lang, 0), 0) <= 0.02 * n[lang, 0]


def test_quality_in_four_languages(spark):
    from vecgrove.llm.quality import assess

    prose = " ".join(f"word{k}" for k in range(60)) + "."
    lines = ["Alle Rechte vorbehalten.", "Tous droits RÉSERVÉS.", "Todos los derechos reservados.", "Weiterlesen!", "Lire la suite!", "Iniciar sesión!", "Our privacy policy."]
    got = by_id(assess(spark.createDataFrame([(k, prose + "\n" + x) for k, x in enumerate(lines)], "doc_id bigint, text string")))
    assert all(got[k].cleaned == prose and got[k].kept for k in range(len(lines)))


def test_quality(docs, rows, nothing):
    from vecgrove.llm.quality import assess

    got = by_id(assess(docs))
    for i, text in rows:
        text = text or ""
        w, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
        grams = list(zip(w, w[1:], w[2:]))
        count, cover = Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                cover |= {k, k + 1, k + 2}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        verdict = [plain_verdict(x) for x in text.split("\n")]
        left = [x for x, v in zip(text.split("\n"), verdict) if v]
        lost = sum(map(len, w)) - sum(len(y) for x in left for y in WORDS.findall(x))
        assert (r.n_lines, r.n_failed_lines, r.lost_chars, r.cleaned) == (len(verdict), verdict.count(False), lost, "\n".join(left))
        assert r.kept == (not r.base_failed and 100 * lost <= 30 * r.word_chars)
    assert assess(nothing).count() == 0
    assert not re.search("Python|Pandas|Arrow", assess(docs)._jdf.queryExecution().executedPlan().toString())


def test_quality_lines(spark):
    from vecgrove.llm.quality import assess

    prose = " ".join(f"word{k}" for k in range(60)) + "."
    texts = [prose + "\nHome | About | News | Contact", prose + "\nAll rights reserved by us.", prose + "\nno end mark here", prose + "\n\n" + prose.replace("word", "w"), "Home | About | News | Contact\n" * 30 + prose]
    got = by_id(assess(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert [got[k].cleaned for k in range(3)] == [prose] * 3
    assert got[3].cleaned == texts[3] and got[3].n_failed_lines == 0
    assert [got[k].kept for k in range(5)] == [True] * 4 + [False]


# ---- 3


def components(rows, gram=5):
    sets = {}
    for i, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + gram]) for k in range(max(1, len(w) - gram + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block,bits,counted", [(2_000_000, 30, True), (300, 30, False), (100, 10, False)])
def test_jaccard_join(docs, rows, nothing, monkeypatch, block, bits, counted):
    """Also in small blocks, and with a join in place of the filter."""
    from vecgrove.llm import flags, jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(flags, "MOST_BITS", bits)
    monkeypatch.setattr(jaccard_join, "PART_GRAMS", 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, count_links=counted).collect()}
    want = components(rows)
    assert got == want
    assert sum(i != c for i, (_, c) in want.items()) > 5
    assert jaccard_join.near_duplicates(nothing, count_links=counted).count() == 0


def test_jaccard_chain_in_blocks(spark, monkeypatch):
    """A chain, most of which doesn't link with the pivot, in many blocks."""
    from vecgrove.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 150)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[3 * k : 3 * k + 60]) for k in range(16)] + [" ".join(words[140:200])]
    want = {i: c for i, (_, c) in components(list(enumerate(texts))).items()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df, count_links=False).collect()}
    assert got == want and len(set(want.values())) < len(texts)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_jaccard_links_are_counted_once(spark, monkeypatch, block):
    """Every class has the number of classes that it links with, not its degree
    in a forest."""
    from vecgrove.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    words, texts = [f"w{k}" for k in range(160)], []
    texts += [" ".join(words[3 * k : 3 * k + 60]) for k in range(12)]  # a chain
    texts += [" ".join([f"c{j}" for j in range(70)] + [f"own{k}"]) for k in range(9)]  # all link
    texts += [texts[3], texts[14], texts[14].upper(), "alone in the world of words", ""] + corpus(5, 40)
    sets = []
    for text in texts:
        w = WORDS.findall(text.translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    kinds = {s for s in sets if s}
    near = {s: sum(100 * len(s & t) >= 75 * len(s | t) for t in kinds if t != s) for s in kinds}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == {k: (sets.index(s), near[s]) if s else (k, 0) for k, s in enumerate(sets)}
    assert got[14] == (14, 8)


def test_jaccard_chain_links_beyond_the_pivot(spark):
    """A chain of texts where only neighbours are near each other."""
    from vecgrove.llm.jaccard_join import near_duplicates

    words = [f"w{k}" for k in range(140)]
    chain = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(20)]
    far = [(100, " ".join(words[70:140])), (None, chain[0][1])]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(chain + far, "doc_id bigint, text string")).collect()}
    want = {i: c for i, (_, c) in components(chain + far[:1]).items()}
    assert got[None] is None and got[100] == want[100]
    assert {got[k] for k in range(20)} == {None}  # the null identifier is the smallest


def test_prefix_tree():
    from vecgrove.llm.jaccard_join import tree_links

    r = random.Random(2)
    for trial in range(150):
        bases = [r.sample(range(60), r.randint(1, 25)) for _ in range(4)]
        sets = []
        for _ in range(r.randint(1, 25)):
            s = set(r.choice(bases)) | {r.randrange(60) for _ in range(r.randint(0, 4))}
            sets.append(np.array(sorted(s), np.uint64))
        side = None if trial % 2 else [0, *(r.randint(0, 1) for _ in sets[1:])]
        root, plain = list(range(len(sets))), [set(x.tolist()) for x in sets]

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                if (side is None or side[a] != side[b]) and 100 * len(plain[a] & plain[b]) >= 75 * len(plain[a] | plain[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = {k: a for a, k in tree_links(sets, side, 75, 100)}
        assert [got.get(k, k) for k in range(len(sets))] == [find(k) for k in range(len(sets))]


def test_prefix_tree_leaves_subtrees():
    """The probe's items behind the path bound the walk: below a node after
    which it has too few left, nothing is visited."""
    from vecgrove.llm.jaccard_join import Tree

    head = list(range(10))
    sets = [np.array(head + [100 + 20 * a + j for j in range(5)] + [1000 + 10 * b + j for j in range(5)]) for a in range(6) for b in range(6)]
    sets += [np.array(head + [10 + j for j in range(9)] + [2000])]
    tree, probe, inside = Tree(sorted(sets, key=list)), np.arange(20), np.zeros(3000, bool)
    inside[probe] = True
    found = list(tree.probe(probe, inside, 75, 100))
    assert [n for _, n in found] == [19]
    # root, head, its seven branches; none of the 36 leaves below six of them
    assert len(tree.parent) == 2 + 7 + 36 and tree.visited == 9


# ---- 4 and 8


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    return path, Tokenizer.from_file(path)


def test_sstable(spark, docs, rows, nothing, tmp_path):
    from vecgrove.llm.sstable import Reader, lookup, read_shards, write_shards

    path, tok = tokenizer("word_bpe_49k.json")
    shards = write_shards(docs, path, f"file://{tmp_path}/a")
    got = sorted(read_shards(spark, shards).collect(), key=lambda r: r.start)
    start, ids_of = 0, {}
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    for r, (i, text) in zip(got, want, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
        ids_of[i] = ids
    found = lookup(spark, shards, spark.createDataFrame([(10,), (33,), (123456,), (None,)], "doc_id bigint")).collect()
    assert sorted(r.doc_id for r in found) == [10, 10, 33]
    assert all(r.ids == ids_of[r.doc_id] for r in found if r.doc_id == 33)
    reader = Reader(shards[0].url)
    assert [i for i, _ in reader.scan()] == sorted(i for i, _ in reader.scan())
    assert reader.get(-5) == []
    assert write_shards(nothing, path, f"file://{tmp_path}/b") == []
    assert read_shards(spark, []).count() == 0


def test_sstable_null_and_negative_ids(spark, tmp_path):
    from vecgrove.llm.sstable import lookup, read_shards, write_shards

    path, _ = tokenizer("word_bpe_49k.json")
    shards = write_shards(spark.createDataFrame([(5, "five"), (None, "none"), (-7, "minus")], "doc_id bigint, text string"), path, f"file://{tmp_path}/c")
    assert [r.doc_id for r in sorted(read_shards(spark, shards).collect(), key=lambda r: r.start)] == [None, -7, 5]
    got = lookup(spark, shards, spark.createDataFrame([(None,), (-7,), (6,)], "doc_id bigint")).collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in got) == [(False, None), (True, -7)]


def test_codec_equals_tokenizer():
    from vecgrove.llm.bpe import Codec

    r = random.Random(1)
    marks = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\x85", "　", "\x1c", "é", "É", "漢", "😀", "1", "!", "#", "the", "Ab", "<|endoftext|>", "\t", "​", "́", "'S", "ing", ".", ",", "word.", " word,"]
    for name, leaf in (("byte_bpe_50k.json", 3), ("byte_bpe_50k.json", 16), ("byte_bpe_50k.json", 2048), ("word_bpe_49k.json", 0)):
        path, tok = tokenizer(name)
        codec = Codec(path, leaf, table_bytes=100_000)
        assert codec.kind == {"b": "bytes", "w": "words"}[name[0]]
        for k in range(2500):
            text = "".join(r.choice(marks) for _ in range(r.randint(0, 80)))
            if k % 2:
                text = text.replace(" ", "").replace("\n", "")
            ids = tok.encode(text, add_special_tokens=False).ids
            assert codec.encode(text).tolist() == ids, text
            assert codec.encode_tree(text).tolist() == ids, text
            if name[0] == "b":
                assert codec.decode(ids) == tok.decode(ids, skip_special_tokens=False)
        assert codec.held < 200_000
    assert codec.joins == 0


def test_codec_of_another_kind_of_file(tmp_path):
    """A tokenizer file whose cuts are not known is left to the library."""
    import json

    from tokenizers import Tokenizer
    from vecgrove.llm.bpe import Codec

    path, _ = tokenizer("byte_bpe_50k.json")
    config = json.loads(open(path).read())
    config["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}
    (tmp_path / "other.json").write_text(json.dumps(config))
    codec, tok = Codec(str(tmp_path / "other.json"), 16), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert codec.kind is None
    for text in ("two words and more of them", "", "a <|endoftext|> b", "x" * 50):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert codec.encode_tree(text).tolist() == codec.encode(text).tolist() == ids
        assert codec.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_tree_concatenation_of_whole_texts(monkeypatch):
    """Texts of the table go through joins; so do texts without any place to cut."""
    import pandas as pd
    from vecgrove.llm import bpe

    path, tok = tokenizer("byte_bpe_50k.json")
    codec = bpe.Codec(path, leaf=64)
    texts = ["a" * 5000, "ab" * 3000, "=" * 3001, "naïve漢字" * 700, "x<|endoftext|>" * 200, "don't'" * 400, " " * 4000 + "x", "1234567890" * 300, " \n" * 900, "it's !'s  ''s 'll" * 90]
    for text in texts:
        assert codec.encode_tree(text).tolist() == tok.encode(text, add_special_tokens=False).ids
    assert codec.joins > 500
    codec, lengths = bpe.Codec(path), 0
    for text in pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"].dropna():
        assert codec.encode_tree(text).tolist() == tok.encode(text, add_special_tokens=False).ids
        lengths += len(text)
    assert codec.joins > lengths / codec.leaf / 4 and codec.windows < 2 * codec.joins
    monkeypatch.setattr(bpe, "WIDE", 1000)  # leaves by threads
    long = " ".join(f"word{k} naïve 漢字" for k in range(100_000))
    assert codec.encode_tree(long).tolist() == tok.encode(long, add_special_tokens=False).ids
    assert codec.decode(codec.encode_tree(long)) == long


def test_bpe_query(docs, rows, nothing):
    from vecgrove.llm.bpe import encode_decode

    path, tok = tokenizer("byte_bpe_50k.json")
    got = by_id(encode_decode(docs, path))
    for i, text in rows:
        assert got[i].ids == tok.encode(text or "", add_special_tokens=False).ids and got[i].decoded == (text or "")
    assert encode_decode(nothing, path).count() == 0


# ---- 6


def test_decontamination(spark, docs, nothing):
    from vecgrove.llm.decontaminate import leaks

    r = random.Random(4)
    items = ["".join(r.choice("abcdefgh ") for _ in range(n)).strip() for n in (60, 100, 160)]
    edited = list(items[2])
    for k in (20, 50, 90, 120):
        edited[k] = "Z"
    del edited[70]
    texts = {1: "before " + items[0].upper() + " after", 2: "x " + items[1].replace(" ", " \n ") + " y", 3: "".join(edited), 4: items[1][: len(items[1]) // 2], 5: items[2] + " and " + items[2], 6: None, 7: ""}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(k, t, 0) for k, t in enumerate(items)] + [(90, None, 0), (91, "short", 0), (92, items[0], 0)], "item_id bigint, text string, doc_id int")
    for block in (16_000_000, 50):
        got = {(x.doc_id, x.item_id): (x.edits, x.begin) for x in leaks(df, bench, block_chars=block).collect()}
        assert got == {(1, 0): (0, 7), (1, 92): (0, 7), (2, 1): (0, 2), (3, 2): (5, 0), (5, 2): (0, 0)}
    assert leaks(nothing, bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0
    assert leaks(docs, bench).count() == 0


def distance_within(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_decontamination_against_full_alignment():
    """Passages of every length from 1 to 70, as they are and edited, among
    unrelated ones: the edits found are those of a full alignment, or none."""
    from vecgrove.llm.decontaminate import by_gram, code_points

    r, hits = random.Random(3), 0
    for trial in range(70):
        letters = "ab " if trial % 3 == 0 else "abcdefgh "
        sizes = [trial + 1, r.randint(1, 70), r.randint(60, 110)]
        items = ["".join(r.choice(letters) for _ in range(n)).strip() or "a" for n in sizes]
        chars = [x[0] for x in map(code_points, ([x] for x in items))]
        items = ["".join(map(chr, x)) for x in chars]
        texts = [f"ab {items[0]} ba"]
        for _ in range(3):
            it = list(r.choice(items))
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(it))
                it[k : k + r.randint(0, 1)] = r.choice(["", r.choice(letters), r.choice(letters)])
                it = it or ["a"]
            texts.append("".join(r.choice(letters) for _ in range(r.randint(0, 80))) + " " + "".join(it) + " ab")
        c, at = code_points(texts)
        got = {}
        for sized in by_gram([0, 1, 2], chars, 6 if trial % 2 else 12, 5):
            assert min(sized.need) >= 1
            got |= {(t, sized.ids[i]): v for (t, i), v in sized.find(c, at).items()}
        for t in range(4):
            body = "".join(map(chr, c[at[t] : at[t + 1]]))
            for i in range(3):
                e = distance_within(items[i], body)
                assert (got[t, i][0] if (t, i) in got else None) == (e if e <= len(items[i]) * 5 // 100 else None), (items[i], body)
                if (t, i) in got:
                    hits += 1
                    edits, begin, end, _ = got[t, i]
                    assert distance_within(items[i], body[begin:end]) == edits
    assert hits > 150


def test_decontamination_of_templates(monkeypatch):
    """Passages with one opening against texts with that opening; and the same
    answer when postings and alignments are worked through in small pieces."""
    import time

    from vecgrove.llm import decontaminate as D

    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    opening = word(50)
    items = [opening + word(50) for _ in range(2000)]
    texts = [opening + word(58) for _ in range(397)] + ["x" + items[7] + "y", "zz" + items[1234][:70] + "!" + items[1234][70:], opening + items[9]]
    c, at = D.code_points(texts)
    chars = [D.code_points([x])[0] for x in items]
    began = time.time()
    (sized,) = D.by_gram(list(range(2000)), chars, 12, 5)
    found = sized.find(c, at)
    assert time.time() - began < 60
    want = {(397, 7), (398, 1234), (399, 9)}
    assert {k: v[0] for k, v in found.items() if k in want} == {(397, 7): 0, (398, 1234): 1, (399, 9): 0}
    for t, i in set(found) - want:  # by chance near
        assert distance_within(items[i], texts[t]) <= 5
    monkeypatch.setattr(D, "CELLS", 500)
    monkeypatch.setattr(D, "POSTINGS", 3000)
    last = slice(int(at[395]), int(at[400]))
    few = sized.find(c[last], at[395:] - at[395])
    assert few == {(t - 395, i): v for (t, i), v in found.items() if t >= 395}


def test_decontamination_of_edits_at_the_beginning():
    """One character inserted or deleted near the beginning, at every offset."""
    from vecgrove.llm.decontaminate import Passages, code_points

    r = random.Random(6)
    item = "".join(r.choice("abcdefgh") for _ in range(30))
    p = Passages([0], [code_points([item])[0]], 12, 5)
    for place in range(1, 12):
        for edited in (item[:place] + "z" + item[place:], item[:place] + item[place + 1 :]):
            for offset in range(8):
                found = p.find(*code_points(["y" * offset + edited + "yyyy"]))
                assert found[0, 0][0] == 1, (place, offset)


def test_decontamination_of_short_passages(spark):
    """Passages of every length are found verbatim, and only where they stand."""
    from vecgrove.llm.decontaminate import leaks

    r = random.Random(8)
    items = ["".join(r.choice("abcdefghijklmnop") for _ in range(n)) for n in range(5, 71)]
    texts = [f"x{'y' * (k % 3)} {t} z {t}" for k, t in enumerate(items)] + [t[:-1] for t in items[:7]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, ""), (51, items[0])], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): (x.edits, x.begin, x.end) for x in leaks(docs, bench).collect()}
    want = {(k, k): (0, texts[k].index(t), texts[k].index(t) + len(t)) for k, t in enumerate(items)}
    assert got == want | {(0, 51): want[0, 0]}
    edited = spark.createDataFrame([(k, f"x {t[:k]}Z{t[k + 1:]} y") for k, t in enumerate(items) if len(t) >= 20], "doc_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in leaks(edited, bench).collect()}
    assert got == {(k, k): 1 for k, t in enumerate(items) if len(t) >= 20}


# ---- 7


@pytest.mark.parametrize("width", [20, 5])
def test_recompression(docs, rows, nothing, width):
    from vecgrove.llm.recompression import remove_repeats

    got, first = by_id(remove_repeats(docs, width=width)), {}
    for i, text in rows:
        w, gone = WORDS.findall(text or ""), set()
        for a in range(len(w) - width + 1):
            if first.setdefault(tuple(w[a : a + width]), (i, a)) != (i, a):
                gone.update(range(a, a + width))
        assert got[i].kept == " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
    assert remove_repeats(nothing).count() == 0


def test_recompression_of_hot_symbols(spark, docs, rows, monkeypatch):
    """The same answer where symbols count as hot from two windows on, with
    small batches and many groups, with and without a filter."""
    from vecgrove.llm import flags
    from vecgrove.llm import recompression as R

    want = {r.doc_id: (r.kept, r.n_removed) for r in R.remove_repeats(docs).collect()}
    assert sum(n > 0 for _, n in want.values()) > 5
    whole = R.repeated_spans
    monkeypatch.setattr(R, "repeated_spans", lambda df, width: whole(df, width, batch_windows=300))
    monkeypatch.setattr(R, "parts_for", lambda df: 7)
    for hot, bits in ((1, 30), (10**9, 10)):
        monkeypatch.setattr(R, "HOT", hot)
        monkeypatch.setattr(flags, "MOST_BITS", bits)
        assert {r.doc_id: (r.kept, r.n_removed) for r in R.remove_repeats(docs).collect()} == want


def test_recompression_finds_by_symbols(spark, monkeypatch):
    """With names that never meet, no repeat is found between documents."""
    from vecgrove.llm import recompression as R

    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(k, f"x{k} {text} y{k}") for k in range(6)], "doc_id bigint, text string").repartition(6)
    assert sorted(r.n_removed for r in R.remove_repeats(df).collect()) == [0] + [50] * 5
    plain = R.window_symbols
    monkeypatch.setattr(R, "window_symbols", lambda *a: ((b, s ^ np.random.default_rng().integers(0, 1 << 63, len(s), np.uint64), p) for b, s, p in plain(*a)))
    assert sum(r.n_removed for r in R.remove_repeats(df).collect()) == 0


def test_window_symbols_depend_on_the_window_alone():
    from vecgrove.llm.recompression import window_symbols

    r = np.random.default_rng(0)
    for trial in range(60):
        values = r.integers(0, 3 if trial % 2 else 50, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        owner = np.sort(r.integers(0, 3, 400))
        whole = {int(b): (int(k), int(p)) for got in window_symbols(values, owner, 20) for b, k, p in zip(*got)}
        pieces = {int(b): (int(k), int(p)) for got in window_symbols(values, owner, 20, segment=37) for b, k, p in zip(*got)}
        assert whole == pieces
        seen = {}
        for b, k in whole.items():
            assert seen.setdefault(values[b : b + 20].tobytes(), k) == k
        assert len(set(whole.values())) == len(seen)


def test_words_in_small_blocks():
    """Texts that are longer than a block are cut at gaps only."""
    import pyarrow as pa
    from vecgrove.llm.words import words

    texts = corpus(3, 30) + ["wide " * 40_000, "z" * 3000, None]
    for block in (1, 7, 100, 2_000_000):
        for lower in (False, True):
            got, at = words(pa.array(texts), lower, block)
            want, ends = words(pa.array(texts), lower, 1 << 30)
            assert (got == want).all() and (at == ends).all()
    assert np.diff(at).tolist() == [len(WORDS.findall(x or "")) for x in texts]


# ---- 9


def test_warc_round_trip(spark, tmp_path):
    from vecgrove.llm.warc import mark_revisits, read_archives, write_archives

    big = "<p>é" + "x" * 200
    data = [(7, "http://a/ b\r\nX: y", big), (3, "http://c", big), (5, None, big), (9, "u", "small"), (2, "u", "small"), (8, "u", None), (None, "u", big), (10, "u", ""), (11, "u", "q" * 99), (12, "u", "q" * 99), (13, "u", "q" * 100), (14, "u", "q" * 100), (3, "again", big)]
    pages = spark.createDataFrame([(*x, "d") for x in data], "page_id bigint, url string, html string, digest string").repartition(3)
    places = write_archives(mark_revisits(pages), f"file://{tmp_path}/w")
    got = read_archives(spark, places).collect()
    assert len(got) == len(data)
    for r in got:
        html = next(h or "" for i, _, h in data if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        first = {big: 3, "q" * 100: 13}.get(html)
        if first is not None and r.page_id != first:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first, None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, html.encode())
    assert write_archives(mark_revisits(pages.limit(0)), f"file://{tmp_path}/e") == [] and read_archives(spark, []).count() == 0


def test_package_reads_zip64(tmp_path, monkeypatch):
    import zipfile

    from vecgrove.llm.warc import Package

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("one.txt", "0123456789" * 20)
        z.writestr("zwei/é.txt", "abcdefghij" * 30)
        z.writestr(zipfile.ZipInfo("packed"), "x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 a comment"
    p = Package(str(tmp_path / "a.zip"))
    assert set(p.members) == {"one.txt", "zwei/é.txt", "packed"}
    assert p.read("one.txt", 3, 4) == b"3456" and p.read("zwei/é.txt") == b"abcdefghij" * 30
    reads, plain = [], p.read
    monkeypatch.setattr(p, "read", lambda *a: reads.append(a) or plain(*a))
    assert list(p.pieces("one.txt", [(0, 3), (3, 4), (7, 30), (50, 2), (40, 1), (41, 1)], 10)) == [b"012", b"3456", b"789" + b"0123456789" * 2 + b"0123456", b"01", b"0", b"1"]
    assert [a[1:] for a in reads] == [(0, 7), (7, 30), (50, 2), (40, 2)] and list(p.pieces("one.txt", [])) == []
    for bad in (lambda: p.read("packed"), lambda: p.read("one.txt", 199, 5)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "b.zip").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        Package(str(tmp_path / "b.zip"))


# ---- 10


def test_kneser_ney(spark, docs, rows, nothing, tmp_path):
    from pyspark.sql import functions as F

    from vecgrove.llm.kneser_ney import held_out, score, train

    texts = {i: [*WORDS.findall((t or "").translate(LOWER)), "</s>"] for i, t in rows}
    every = [(r.doc_id, r.text) for r in docs.collect()]
    learn = [i for i, _ in every if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in learn for w in texts[i])
    total, distinct = sum(count.values()), len(count)
    pairs = Counter(p for i in learn for p in zip(["<s>", *texts[i]], texts[i]))
    context, before, kinds = Counter(), Counter(), defaultdict(Counter)
    for (a, b), n in pairs.items():
        context[a] += n
        before[b] += 1
        kinds[a][min(n, 3)] += 1

    def discounts(c):
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return 0, 0.5, 0.5, 0.5
        y = n1 / (n1 + 2 * n2)
        return 0, *(min(max(x, 0), k) for k, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))

    d, low = discounts(pairs), discounts(before)
    left_low = sum(low[min(v, 3)] for v in before.values()) / len(pairs)

    def p(a, b):
        lower = (before[b] - low[min(before[b], 3)]) / len(pairs) + left_low / (distinct + 1)
        if not context[a]:
            return lower
        return (pairs[a, b] - d[min(pairs[a, b], 3)]) / context[a] + sum(d[k] * kinds[a][k] for k in (1, 2, 3)) / context[a] * lower

    assert abs(sum(p("te", w) for w in count) + p("te", "never seen") - 1) < 1e-9
    model = train(docs.filter(~held_out(F.col("doc_id"))), f"file://{tmp_path}/m", batch_tokens=500)
    assert (model.tokens, model.distinct, model.bigrams, model.texts) == (total, distinct, len(pairs), len(learn)) and model.hot
    got = by_id(score(docs, model))
    for i, words in texts.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *words], words)), rel_tol=1e-9)
    assert score(nothing, model).count() == 0
    empty = train(nothing, f"file://{tmp_path}/n")
    assert empty.tokens == 0 and all(math.isfinite(r.score) for r in score(docs, empty).collect())


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_of_any_order(spark, docs, rows, nothing, tmp_path, order):
    """Against a plain recursive model; order 2 equals the bigram model."""
    from vecgrove.llm.kneser_ney import score, train
    from vecgrove.llm.ngram_orders import train_order

    texts = {i: ["<s>"] * (order - 1) + [*WORDS.findall((t or "").translate(LOWER)), "</s>"] for i, t in rows}
    every = [texts[r.doc_id] for r in docs.collect()]
    a = {order: Counter(tuple(t[k : k + order]) for t in every for k in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        a[k] = Counter(g[1:] for g in a[k + 1])
    plain, d, context = Counter(), {}, {}
    for g, n in a[order].items():
        plain[g[-1]] += n
    for k in a:
        n1, n2, n3, n4 = (sum(v == x for v in a[k].values()) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 and n3 else 0
        d[k] = (0, *(min(max(x, 0), j) for j, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))) if y else (0, 0.5, 0.5, 0.5)
        context[k] = defaultdict(list)
        for g, v in a[k].items():
            context[k][g[:-1]].append(v)

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / (len(plain) + 1)
        seen = context[len(g)].get(g[:-1])
        if not seen:
            return below
        v, k = a[len(g)][g], d[len(g)]
        return (v - k[min(v, 3)]) / sum(seen) + sum(k[min(x, 3)] for x in seen) / sum(seen) * below

    model = train_order(docs, f"file://{tmp_path}/m", order)
    assert (model.tokens, model.distinct, model.types[-1]) == (sum(plain.values()), len(plain), len(a[order]))
    got = by_id(score(docs, model))
    for i, t in texts.items():
        want = sum(math.log10(p(tuple(t[k : k + order]))) for k in range(len(t) - order + 1))
        assert math.isclose(got[i].score, want, rel_tol=1e-9) and got[i].n_tokens == len(t) - order + 1
    if order == 2:
        same = by_id(score(docs, train(docs, f"file://{tmp_path}/b")))
        assert all(math.isclose(same[i].score, got[i].score, rel_tol=1e-9) and same[i].base_score == got[i].base_score for i in texts)
    assert train(docs, f"file://{tmp_path}/t", order=3).order == 3
    empty = train_order(nothing, f"file://{tmp_path}/n", order)
    assert empty.tokens == 0 and all(math.isfinite(r.score) for r in score(docs, empty).collect())
    with pytest.raises(ValueError):
        train(docs, f"file://{tmp_path}/z", order=0)


def test_kneser_ney_maps_a_copy_of_remote_shards(tmp_path, monkeypatch):
    from pyarrow import fs
    from vecgrove.llm import kneser_ney as K
    from vecgrove.llm.common import kept

    monkeypatch.setattr(K, "filesystem", lambda url: (fs.LocalFileSystem(), url.replace("store://", str(tmp_path))))
    place = K._save("store:///d", "x", np.arange(5, dtype="<u8"), np.arange(5, dtype="<i8") * 2)
    kept("kneser_ney").clear()
    keys, values = K._mapped(place, "<u8", "<i8")
    assert keys.tolist() == list(range(5)) and values.tolist() == [0, 2, 4, 6, 8]
    assert isinstance(keys.base, np.memmap) or isinstance(keys, np.memmap)
    assert K._mapped(place, "<u8", "<i8")[0] is keys
    kept("kneser_ney").clear()


def test_paths_of_other_stores():
    from vecgrove.llm.common import filesystem

    assert filesystem("/a/b")[1] == "/a/b" and filesystem("file:///a/b")[1] == "/a/b" and filesystem("file:/a")[1] == "/a"
    for scheme in ("s3", "s3a", "s3n"):
        store, path = filesystem(f"{scheme}://bucket/some/key?region=us-east-1")
        assert store.type_name == "s3" and path == "bucket/some/key"


# ---- 5


def test_lookup_table():
    from vecgrove.llm.sharding import fill, is_prime, moved, preference, table_size

    names = [f"s{k}" for k in range(12)]
    size = table_size(12)
    assert is_prime(size) and size >= 1200
    table = fill(names)
    share = Counter(table)
    assert len(table) == size and max(share.values()) - min(share.values()) <= 1
    # brute force: turns over explicit permutations
    orders = [[(o + j * s) % size for j in range(size)] for o, s in (preference(n, size) for n in names)]
    assert all(sorted(o) == list(range(size)) for o in orders)
    want = [-1] * size
    while -1 in want:
        for k, o in enumerate(orders):
            if -1 in want:
                want[next(x for x in o if want[x] < 0)] = k
    assert table == want
    weighted = Counter(fill(names[:3], 1009, [1, 2, 0]))
    assert weighted[2] == 0 and abs(weighted[1] - 2 * weighted[0]) <= 2
    fewer = fill(names[1:], size)
    assert moved(table, fewer, names, names[1:]) < 0.25
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            fill(bad)
    for kwargs in ({"size": 100}, {"weights": [0, 0]}, {"weights": [1]}, {"size": 4_000_037}):
        with pytest.raises(ValueError):
            fill(["a", "b"], **kwargs)


def test_sharding(spark, docs, nothing, tmp_path):
    from vecgrove.llm.sharding import assign, fill, write_sharded

    names = ["a", "b", "c"]
    table, got = fill(names), assign(docs, names, carry=True).collect()
    assert len(got) == docs.count()
    for r in got:
        slot = int(hashlib.md5(str(r.key).encode()).hexdigest()[:15], 16) % len(table)
        assert (r.slot, r.shard, r.shard_name, r.carried.doc_id) == (slot, table[slot], names[table[slot]], r.key)
    assert assign(nothing, names).count() == 0
    null = assign(spark.createDataFrame([(None,), (None,)], "doc_id bigint"), names).collect()
    assert len({r.shard for r in null}) == 1 and null[0].shard is not None
    write_sharded(docs, names, f"{tmp_path}/s", parts=2)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((r.doc_id, r.shard_name) for r in back.collect()) == sorted((r.key, r.shard_name) for r in got)


# ---- very long texts and missing identifiers


@pytest.fixture(scope="module")
def wide(spark):
    """A text of several MB, twice, and rows without identifier."""
    lines = [" ".join(f"w{k}x{j}" for j in range(118)) + f" line {k}." for k in range(3_000)]
    long = "\n".join(lines)
    rows = [(1, long), (2, long), (None, "a few words without identifier"), (None, None), (None, "other words " + lines[77])]
    return lines, long, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)


def test_long_texts_keep_their_lines(wide):
    from vecgrove.llm.line_dedup import dedup_lines
    from vecgrove.llm.quality import assess

    lines, long, df = wide
    got = {(r.doc_id, r.n_lines): r.n_removed for r in dedup_lines(df).collect()}
    assert got == {(1, 3_000): 0, (2, 3_000): 3_000, (None, 1): 0}
    for r in assess(df).collect():
        if r.doc_id is not None:
            assert (r.n_words, r.n_lines, r.n_failed_lines, r.kept) == (120 * 3_000, 3_000, 0, True)
    assert sorted(r.n_words for r in assess(df).filter("doc_id is null").collect()) == [0, 5, 122]


def test_long_texts_join_and_repeat(spark, wide):
    from vecgrove.llm.decontaminate import leaks
    from vecgrove.llm.jaccard_join import near_duplicates
    from vecgrove.llm.recompression import remove_repeats

    lines, long, df = wide
    for counted in (True, False):
        got = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(df, count_links=counted).collect()}
        assert got == {(1, 120 * 3_000 - 4): 1, (2, 120 * 3_000 - 4): 1, (None, 1): None, (None, 0): None, (None, 118): None}
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(0, 0, 0), (0, 5, 0), (0, 122, 0), (1, 360_000, 120), (2, 360_000, 360_000)]  # the null identifier comes first
    bench = spark.createDataFrame([(None, lines[-1]), (8, lines[77]), (9, None)], "item_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.edits) for r in leaks(df, bench).collect()))
    assert got == [(0, 8, 0), (1, 0, 0), (1, 8, 0), (2, 0, 0), (2, 8, 0)]


def test_long_texts_are_encoded_and_scored(spark, wide, tmp_path):
    from vecgrove.llm.bpe import encode_decode
    from vecgrove.llm.kneser_ney import score, train
    from vecgrove.llm.sstable import read_shards, write_shards
    from vecgrove.llm.warc import mark_revisits, read_archives, write_archives

    lines, long, df = wide
    path, tok = tokenizer("byte_bpe_50k.json")
    want = tok.encode(long, add_special_tokens=False).ids
    got = encode_decode(df, path).collect()
    assert sorted(len(r.ids) for r in got if r.doc_id is None)[0] == 0
    assert all(r.ids == want and r.decoded == long for r in got if r.doc_id is not None) and len(got) == 5
    path, tok = tokenizer("word_bpe_49k.json")
    want = [*tok.encode(long, add_special_tokens=False).ids, 2]
    got = sorted(read_shards(spark, write_shards(df, path, f"file://{tmp_path}/s")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, 1, 2] and all(np.frombuffer(r.ids, "<u4").tolist() == want for r in got[3:])
    scored = score(df, train(df, f"file://{tmp_path}/m")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in scored) == [(0, 1, 1), (0, 6, 6), (0, 123, 123), (1, 360_001, 360_001), (2, 360_001, 360_001)]
    pages = df.selectExpr("doc_id page_id", "'u' url", "text html")
    got = read_archives(spark, write_archives(mark_revisits(pages), f"file://{tmp_path}/w")).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type) for r in got if r.payload_bytes > 1000) == [(1, len(long), "response"), (2, len(long), "revisit")]
