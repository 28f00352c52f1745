import re

from test_operators import components, corpus


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    prose = [t + "\n" + " ".join(f"k{k}x{j}." for j in range(60)) for k, t in enumerate(corpus(7, 40))]
    passage = "the quick brown fox jumps over the lazy dog while nobody is looking at it at all"
    prose[5] += "\n" + passage + "."
    prose[6] = prose[8]
    prose[7] = "a | b | c | d\n" * 40
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(prose)] + [(900, None, None, None, None), (901, "", "en", "s", 0), (30, prose[30], "en", "s0", len(prose[30]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    now, seen = docs, {}
    for n, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = {r.doc_id: r for r in now.collect()}, spark.read.parquet(f"{tmp_path}/{name}")
        after = seen[name] = {r.doc_id: r for r in now.collect()}
        assert set(after) <= set(before)
        if n < 4:
            assert all(r.n_chars == len(r.text) and r.source == before[i].source for i, r in after.items())
        if name == "quality_rules":
            assert not {7, 900, 901} & set(after) and 5 in after
        if name == "line_dedup":
            assert 6 not in after or not after[6].text.strip() == before[6].text.strip() or 8 not in after
        if name == "jaccard_join":
            want = components([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
            assert now.count() == len(after)
        if name == "decontamination":
            assert set(before) - set(after) == {5}
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: r.n_tokens for i, r in seen["bpe"].items()}
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_decontamination_goes_by_identifier_and_text(spark, tmp_path):
    """A leaking row takes along neither rows that share its identifier nor
    those that have none, like it."""
    import corpus_pipeline as P

    passage = "the quick brown fox jumps over the lazy dog while nobody is looking at it at all"
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"see: {passage}"), (None, "nothing to see here"), (None, None), (4, passage), (4, "another text"), (4, passage), (5, "clean"), (5, "clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = P.decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == [(0, ""), (0, "nothing to see here"), (4, "another text"), (5, "clean"), (5, "clean")]


def test_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_entry_registers_everything():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names
    assert set(E.oracle_sql()) <= names
