"""Line dedup: a suffix array over line identifiers, by prefix doubling.

The lines of all documents form one sequence; a line's place in it is ``g``,
and every document ends at its own sentinel. Doubling ranks the suffixes by
their first 1, 2, 4, ... lines. A suffix whose rank is its own is settled and
only looked up from then on, so the rounds shrink fast. Ranks come from a range
sort with the place as tie-breaker, so one line that a third of all documents
share is spread over many tasks. In the finished array the longest common
prefix of neighbours follows from the rank tables, largest step first; stretches
whose common prefixes reach ``min_lines`` are the intervals of repeated runs,
and in each the earliest place stays while later copies are deleted. A line of
``long_words`` words counts alone: its interval is that of its rank by one line.

DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_total
from .common import WORD_GAP, pick, settle

MIN_LINES = 2
#: So many words make one line a run by itself, where asked for.
LONG_WORDS = 20
#: Rows of the suffix array that may meet in one task, and rows of buckets, as
#: powers of 2. One row for 2 ** (sum) suffixes comes to the driver.
BUCKET_BITS, GROUP_BITS = 13, 12
NO_ID = -(1 << 63)


def _with_edges(df: DataFrame, edges: list[tuple], schema: str) -> DataFrame:
    """Join the few values that each range partition takes over from those
    before it (as many rows as partitions)."""
    return df.join(F.broadcast(_rows(df.sparkSession, edges, schema)), "p")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers, as SQL values: no Python worker unpacks it."""
    fields = [x.split() for x in schema.split(", ")]
    as_sql = lambda v, kind: f"cast({'null' if v is None else str(v).lower()} as {kind})"
    if not rows:
        return _rows(spark, [(None,) * len(fields)], schema).limit(0)
    values = ", ".join("(" + ", ".join(as_sql(v, kind) for v, (_, kind) in zip(r, fields)) + ")" for r in rows)
    return spark.sql(f"select * from values {values} as t({', '.join(n for n, _ in fields)})")


def carry_over(buckets: DataFrame) -> DataFrame:
    """``bucket, before, next_head``: the last ``begin`` of the buckets before
    each and the ``head`` of the one after it, for ``bucket, begin, head``.

    Buckets are worked through in groups; what lies before and after a group,
    one row a group, goes over the driver."""
    group = F.shiftright("bucket", GROUP_BITS)
    held = settle(buckets.withColumn("p", group), "buckets")
    summary = held.groupBy("p").agg(F.max("begin").alias("begin"), F.min_by("head", "bucket").alias("head")).orderBy("p").collect()
    last, edges = None, []
    for k, r in enumerate(summary):
        edges.append((r.p, last, summary[k + 1].head if k + 1 < len(summary) else None))
        last = r.begin if r.begin is not None else last
    w = Window.partitionBy("p").orderBy("bucket")
    inside = held.select(
        "p", "bucket",
        F.last("begin", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("begin_before"),
        F.lead("head").over(w).alias("head_after"),
    )
    full = _with_edges(inside, edges, "p bigint, group_before bigint, group_after bigint")
    return full.select("bucket", F.coalesce("begin_before", "group_before").alias("before"), F.coalesce("head_after", "group_after").alias("next_head"))


def ranked(rows: DataFrame, base: Column | None) -> DataFrame:
    """``g, e, rank, alone, later`` for rows ``g, e, a, b`` in the order (a, b, g),
    ``later`` where an equal pair comes before; without ``base`` also ``a``.

    Equal pairs share the place of their first row as rank. With ``base`` (the
    old rank ``a``) places count within the rows of equal ``a``.
    """

    def columns(w):
        first = F.row_number().over(w) == 1
        at = F.row_number().over(w) - 1
        a, b = F.lag("a").over(w), F.lag("b").over(w)
        return [at.alias("at"), F.when(first | (a != F.col("a")), at).alias("new_a"), F.when(first | (a != F.col("a")) | (b != F.col("b")), at).alias("new_b")]

    w = Window.partitionBy("p").orderBy("a", "b", "g")
    dealt = rows.repartitionByRange("a", "b", "g").withColumn("p", F.spark_partition_id())
    local = dealt.select("*", *columns(w))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    parts = settle(
        local.select(
            "g", "e", "a", "b", "p", "at", F.max("new_a").over(so_far).alias("start_a"), F.max("new_b").over(so_far).alias("start_b"),
            F.lead("new_b").over(w).isNotNull().alias("last_b"), F.lead("p").over(w).isNull().alias("last"),
        ),
        "ranks",
    )
    seen, edges, total = None, [], 0
    summary = sorted(parts.groupBy("p").agg(F.count("*").alias("n"), F.min(F.struct("a", "b", "g")).alias("lo"), F.max(F.struct("a", "b", "g", "start_a", "start_b")).alias("hi")).collect())
    for k, r in enumerate(summary):
        same_a = bool(seen and seen[0] == r.lo.a)
        same_b = same_a and seen[1] == r.lo.b
        begin_a = seen[2] if same_a else total
        begin_b = seen[3] if same_b else total
        after = summary[k + 1].lo if k + 1 < len(summary) else None
        goes_on = after is not None and (after.a, after.b) == (r.hi.a, r.hi.b)
        edges.append((r.p, total, begin_a, begin_b, same_b, goes_on))
        seen = (r.hi.a, r.hi.b, begin_a if r.hi.start_a == 0 else total + r.hi.start_a, begin_b if r.hi.start_b == 0 else total + r.hi.start_b)
        total += r.n
    if not edges:
        edges = [(0, 0, 0, 0, False, False)]
    full = _with_edges(parts, edges, "p int, before bigint, begin_a bigint, begin_b bigint, from_before boolean, goes_on boolean")
    start = lambda x: F.when(F.col(f"start_{x}") == 0, F.col(f"begin_{x}")).otherwise(F.col("before") + F.col(f"start_{x}"))
    starts_here = (F.col("at") == F.col("start_b")) & ~((F.col("start_b") == 0) & F.col("from_before"))
    ends_here = F.when(F.col("last"), ~F.col("goes_on")).otherwise(F.col("last_b"))
    rank = start("b") if base is None else base + start("b") - start("a")
    return full.select("g", "e", rank.alias("rank"), (starts_here & ends_here).alias("alone"), (~starts_here).alias("later"), *(["a"] if base is None else []))


def worded(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(f"[^{WORD_GAP}]"))


def line_print(x: Column, long_words: int | None) -> Column:
    """64 bits of a line; with ``long_words`` the last tells whether it is long."""
    if long_words is None:
        return F.xxhash64(x)
    long = F.when(F.length(x) >= 2 * long_words - 1, F.regexp_count(x, F.lit(f"[^{WORD_GAP}]+")) >= long_words).otherwise(False)
    return F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR(long.cast("bigint"))


def line_sequence(docs: DataFrame, long_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``doc, tie, e`` by document; ``g, e, a, b`` by line)."""
    ids = docs.select("doc", "tie", F.transform(worded(F.split("text", "\n", -1)), lambda x: F.struct(line_print(x, long_words).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("ids"))
    by_doc = ids.groupBy("doc", "tie").agg(F.first("ids").alias("ids")).withColumn("n", (F.size("ids") + 1).cast("bigint")).filter("n > 1")
    placed = running_total(by_doc, ["doc", "tie"], "n", "base").withColumn("e", F.col("base") + F.col("n") - 1)
    rows = placed.select("base", "e", F.posexplode("ids").alias("k", "x")).select((F.col("base") + F.col("k")).alias("g"), "e", "x.a", "x.b")
    return placed.select("doc", "tie", "base", "e"), rows


def repeated_runs(rows: DataFrame, min_lines: int = MIN_LINES, long_lines: bool = False) -> DataFrame:
    """Later copies: ``g, e, run, span`` where ``run`` >= ``min_lines`` is the
    longest common prefix with a neighbour in the suffix array and ``span`` the
    lines that go; with ``long_lines`` also lines marked long (``span`` 1)."""
    now = ranked(rows, None)
    single = None
    settled, levels, h = [], [], 1
    while True:
        now = settle(now, "level")
        if h == 1 and long_lines:
            one = F.lit(1).cast("bigint")
            single = now.filter(F.col("later") & (F.col("a").bitwiseAND(F.lit(1)) == 1)).select("g", "e", one.alias("run"), one.alias("span"))
        settled.append(now.filter("alone").select("g", "rank"))
        active = now.filter("not alone").select("g", "e", "rank")
        if active.isEmpty():
            break
        levels.append((h, active))
        known = reduce(DataFrame.union, settled, active.select("g", "rank"))
        inside = active.filter(F.col("g") + h < F.col("e")).withColumn("to", F.col("g") + h)
        ended = active.filter(F.col("g") + h >= F.col("e"))
        nxt = inside.join(known.select(F.col("g").alias("to"), F.col("rank").alias("b")), "to").select("g", "e", F.col("rank").alias("a"), "b")
        now = ranked(nxt.union(ended.select("g", "e", F.col("rank").alias("a"), (-1 - F.col("g")).alias("b"))), F.col("a"))
        h *= 2
    wide = [x for x in levels if x[0] <= min_lines]
    if not wide or wide[-1][0] * 2 <= min_lines:
        none = F.lit(0).cast("bigint")
        return rows.select("g", "e", none.alias("run"), none.alias("span")).limit(0) if single is None else single
    array = reduce(DataFrame.union, settled)
    # suffixes with a chance of a common prefix of min_lines
    sa = settle(wide[-1][1].select("g", "e").join(array, "g").withColumnRenamed("rank", "sa"), "suffixes")
    pairs = sa.join(sa.select(F.col("g").alias("q"), (F.col("sa") + 1).alias("sa")), "sa", "left").withColumn("lcp", F.lit(0).cast("bigint"))
    for n, (step, level) in enumerate(reversed(levels)):
        mine = level.select((F.col("g")).alias("x"), F.col("rank").alias("rx"))
        other = level.select((F.col("g")).alias("y"), F.col("rank").alias("ry"))
        pairs = (
            pairs.join(mine, F.col("x") == F.col("g") + F.col("lcp"), "left")
            .join(other, F.col("y") == F.col("q") + F.col("lcp"), "left")
            .select("g", "e", "q", "sa", (F.col("lcp") + F.when(F.col("rx") == F.col("ry"), step).otherwise(0)).alias("lcp"))
        )
        if n % 3 == 2:
            pairs = settle(pairs, "lcp")
    pairs = settle(pairs, "lcp")
    # intervals: they begin where the common prefix falls short
    by = Window.partitionBy("bucket").orderBy("sa")
    cut = pairs.withColumn("bucket", F.shiftright("sa", BUCKET_BITS)).select(
        "g", "e", "sa", "lcp", "bucket",
        F.max(F.when(F.col("lcp") < min_lines, F.col("sa"))).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("begin"),
        F.lead("lcp").over(by).alias("after"),
    )
    carried = carry_over(cut.groupBy("bucket").agg(F.max("begin").alias("begin"), F.min_by("lcp", "sa").alias("head")))
    run = F.greatest("lcp", F.coalesce("after", "next_head"))
    cut = settle(cut.join(carried, "bucket").select("g", "e", "bucket", run.alias("run"), F.coalesce("begin", "before").alias("begin")), "intervals")
    part = cut.groupBy("begin", "bucket").agg(F.min("g").alias("first"))
    whole = part.groupBy("begin").agg(F.min("first").alias("first"))
    firsts = part.select("begin", "bucket").join(whole, "begin")
    runs = cut.join(firsts, ["begin", "bucket"]).filter("g > first").select("g", "e", F.greatest("run", F.lit(min_lines)).alias("run"), F.lit(min_lines).cast("bigint").alias("span"))
    return runs if single is None else runs.unionByName(single)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, carry: bool = False, long_words: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, text`` (the input's), ``cleaned``,
    ``n_lines``, ``n_removed``, ``longest_run`` (of removed copies, else 0).

    A line is removed iff it lies in ``min_lines`` consecutive lines of its
    document that also start earlier (smaller identifier, or same document
    and earlier line); with ``long_words`` also iff it has that many words and
    stands earlier as it is. Runs are judged on the input. Lines without a word take
    no part and stay. Lines are equal when their text is (compared by 128-bit
    hash). Null or empty texts have no lines to remove and come back as empty
    text. A null identifier sorts first. Rows that share identifier and text
    are one document and get the same result; rows that share only the
    identifier are ordered by a hash of their text. Other columns are not read,
    or with ``carry`` come along inside one column, ``carried``.
    """
    extra = ["carried"] if carry else []
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    rows = pick(df, carry, doc_id=id_col, text=text_col).select("doc_id", doc.alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    docs, lines = line_sequence(rows, long_words)
    later = repeated_runs(lines, min_lines, long_words is not None)
    gone = (
        later.select("e", "run", F.explode(F.sequence("g", F.col("g") + F.col("span") - 1)).alias("g"))
        .groupBy("e").agg(F.collect_set("g").alias("gone"), F.max("run").alias("longest_run"))
        .join(docs, "e")
        .select("doc", "tie", "base", "gone", "longest_run")
    )
    joined = rows.join(gone, ["doc", "tie"], "left")
    lines_ = F.split("text", "\n", -1)
    places = F.filter(F.transform(lines_, lambda x, i: F.when(x.rlike(f"[^{WORD_GAP}]"), i)), lambda i: i.isNotNull())
    joined = joined.select(
        "doc_id", "text", *extra, lines_.alias("lines"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"),
        F.when(F.col("gone").isNotNull(), F.transform(F.array(places), lambda p: F.transform(F.col("gone"), lambda g: F.get(p, (g - F.col("base")).cast("int"))))[0]).alias("gone"),
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return joined.select(
        "doc_id", "text", *extra,
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")).alias("cleaned"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.col("longest_run").cast("bigint").alias("longest_run"),
    )
