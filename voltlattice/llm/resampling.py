"""Importance resampling towards a target distribution, with the features of repeated lines computed once.

Features are runs of 1 to ``ngrams`` consecutive words, hashed into buckets; a document's weight is
the mean of its features' gains, ``log p_target / p_raw`` by bucket with one added to each count. A
Gumbel number drawn from the id is added, and the highest sums are the sample: a draw without
replacement by weight.

Newlines separate words, so they cut a text into segments:

1. Lines are grouped by their text (counted in each task before they move) and each distinct line is
   cut into words and hashed once. The corpus counts are its features times its occurrences.
2. Runs that cross a newline belong to no line. They are found from the words at the line ends of a
   document and added to the corpus counts and to the document's gains. With ``ngrams`` 1 there are none.
3. A line's sum of gains is computed once too; documents add up those of their lines through a join on
   the line's 128-bit hash. Lines that are more than 1/1000 of all occurrences (so fewer than 1000) are
   broadcast, so the key of a frequent line is never one task's.

The gains are one array of ``buckets`` numbers. Ranks come from counts of each score (integers of a
bounded range), so only the rows of one score are ordered together.

Cases: a null text is an empty one, without features; weight 0. A null id is the text ``2024:``
followed by nothing, and comes last among ties. Rows with equal id and text are all returned, with
ranks that follow each other; ties of score and id go by a hash of the text. A very long text is only
cut into lines; one very long line is held by one task. An empty target, or an empty table, leaves
only the added ones. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltlattice.llm.common import let, materialize, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A line with more than one of so many occurrences is broadcast with its gains.
HOT_SHARE = 1000
#: Copies of one row are dealt out in runs of this many.
COPIES_RUN = 65536


def words(line: Column) -> Column:
    return F.filter(F.split(F.translate(line, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _runs(tokens: Column, size: int, keep=None) -> Column:
    """All runs of ``size`` consecutive words; ``keep`` chooses by the place of the first one."""
    if size == 1:
        return tokens
    places = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - size + 1)).otherwise(F.array().cast("array<int>"))
    if keep:
        places = F.filter(places, keep)
    return F.transform(places, lambda p: F.array_join(F.slice(tokens, p, size), " "))


def _buckets(features: Column, buckets: int) -> Column:
    return F.transform(features, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def _line_features(line: Column, ngrams: int, buckets: int) -> Column:
    """(n_words, buckets) of a line, whose words are cut once."""
    return let(words(line), lambda tokens: F.struct(
        F.size(tokens).alias("n_words"), _buckets(F.concat(*(_runs(tokens, n) for n in range(1, ngrams + 1))), buckets).alias("buckets")))


def _crossing_features(text: Column, ngrams: int, buckets: int) -> Column:
    """Buckets of the runs whose words come from more than one line.

    The words are numbered by line; a run crosses where its first and last number differ.
    """
    def found(lines: Column) -> Column:
        line_of = F.flatten(F.transform(lines, lambda ws, k: F.transform(ws, lambda _: k)))
        return let(F.flatten(lines), lambda tokens: let(line_of, lambda of: crossing(tokens, of)))

    def crossing(tokens: Column, of: Column) -> Column:
        def runs(n: int) -> Column:
            return _runs(tokens, n, lambda p: F.element_at(of, p) != F.element_at(of, p + n - 1))

        return _buckets(F.concat(*(runs(n) for n in range(2, ngrams + 1))), buckets)

    return let(F.transform(F.split(text, "\n"), words), found)


def _hashes(text: str, *names: str) -> list[Column]:
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d1, d2, line): every line but empty ones; d1 and d2 tell the text."""
    keyed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return keyed.select("id", *_hashes("text", "d1", "d2"), F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")


def distinct_lines(docs: DataFrame, ngrams: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(l1, l2, occurrences, n_words, buckets): each distinct line with words, its features computed once."""
    counted = _lines(docs, id_col, text_col).groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
    # A generator: a filter on its columns is not pushed below it, where it would compute them once more.
    cut = counted.select(*_hashes("line", "l1", "l2"), "occurrences", F.inline(F.array(_line_features(F.col("line"), ngrams, buckets))))
    return cut.filter("n_words > 0")


def crossings(docs: DataFrame, ngrams: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, d1, d2, buckets): the features that cross lines, one row for each row of ``docs`` that has some."""
    keyed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return keyed.select("id", *_hashes("text", "d1", "d2"), F.inline(F.array(F.struct(_crossing_features(F.col("text"), ngrams, buckets).alias("buckets"))))).filter("size(buckets) > 0")


def bucket_counts(lines: DataFrame, crossing: DataFrame | None = None) -> DataFrame:
    """(bucket, n): the corpus counts, at most one row a bucket."""
    found = lines.select(F.explode("buckets").alias("bucket"), F.col("occurrences").alias("n"))
    if crossing is not None:
        found = found.unionByName(crossing.select(F.explode("buckets").alias("bucket"), F.lit(1).cast("long").alias("n")))
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): thousandths of the log-likelihood ratio, rounded down, for every bucket."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    totals = both.agg(F.struct(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).alias("v")).scalar()
    both = both.withColumn("all", totals)
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * (F.col("all.s") + buckets)) / ((s + 1) * (F.col("all.t") + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(id_col: str, seed: int) -> Column:
    """Thousandths of a standard Gumbel number drawn from sha256 of ``seed:id``, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _floor_div(a: Column, b: Column) -> Column:
    return ((a - F.pmod(a, b)) / b).cast("long")


def weights(raw: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, d1, d2, copies, n_words, n_features, weight): one row for each distinct id and text."""
    lines = materialize(distinct_lines(raw, ngrams, buckets, id_col, text_col), "resample-lines")
    crossing = materialize(crossings(raw, ngrams, buckets, id_col, text_col), "resample-crossings") if ngrams > 1 else None
    aim = distinct_lines(target, ngrams, buckets, id_col=target.columns[0], text_col=text_col)
    aim_crossing = crossings(target, ngrams, buckets, target.columns[0], text_col) if ngrams > 1 else None
    gain = materialize(gains(bucket_counts(lines, crossing), bucket_counts(aim, aim_crossing), buckets), "resample-gains")
    table = gain.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda g: g["gain"]).alias("v")).scalar()

    def summed(df: DataFrame) -> DataFrame:
        return df.withColumn("_gains", table).withColumn(
            "gain", F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(F.col("_gains"), b))
        ).withColumn("n_features", F.size("buckets").cast("long")).drop("_gains", "buckets")

    valued = materialize(summed(lines), "resample-valued")
    common = valued.agg(F.sum("occurrences").alias("n")).scalar()
    hot = valued.filter(F.col("occurrences") * HOT_SHARE > common).withColumn("hot", F.lit(True))
    places = _lines(raw, id_col, text_col).select("id", "d1", "d2", *_hashes("line", "l1", "l2"))
    values = ["n_words", "n_features", "gain"]
    marked = places.join(F.broadcast(hot.select("l1", "l2", "hot", *values)), ["l1", "l2"], "left")
    rare = marked.filter("hot IS NULL").select("id", "d1", "d2", "l1", "l2").join(valued.select("l1", "l2", *values), ["l1", "l2"])
    parts = marked.filter("hot").select("id", "d1", "d2", *values).unionByName(rare.select("id", "d1", "d2", *values))
    if crossing is not None:
        parts = parts.unionByName(summed(crossing).withColumn("n_words", F.lit(0)).select("id", "d1", "d2", *values))
    # Every row counts once here, so a row without lines has its part too and copies add up evenly.
    rows = raw.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select(
        "id", *_hashes("text", "d1", "d2"), *(F.lit(0).cast("long").alias(v) for v in values), F.lit(1).cast("long").alias("copies"))
    added = rows.unionByName(parts.withColumn("copies", F.lit(0).cast("long"))).groupBy("id", "d1", "d2").agg(
        *(F.sum(v).alias(v) for v in [*values, "copies"]))
    share = {v: _floor_div(F.col(v), F.col("copies")) for v in values}  # exact: every copy gave the same
    one = added.select("id", "d1", "d2", "copies", *(share[v].alias(v) for v in values))
    mean = F.when(F.col("n_features") > 0, _floor_div(F.col("gain"), F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    return one.select("id", "d1", "d2", "copies", "n_words", "n_features", mean.alias("weight"))


def _ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """(id, d1, d2, before): how many rows come before the first copy, for those that begin within ``drawn``.

    Scores are integers of a range that the buckets' counts and the 32 bits of a draw bound, so the
    table of counts by score is small; rows of the same score only are ordered with each other.
    """
    able = scored.filter("able")
    counts = able.groupBy("score").agg(F.sum("copies").alias("n"))
    above = counts.select("score", (F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))).alias("above")).na.fill(0, ["above"])
    reach = able.join(above.filter(F.col("above") < drawn), "score")
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "d1", "d2").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("above") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    return reach.select("id", "d1", "d2", before.alias("before")).filter(F.col("before") < drawn)


def resample(raw: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10000, seed: int = 2024,
             min_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, n_features, weight, score and rank; the drawn ones have ranks 1, 2, 3 ...

    ``target`` has its id first. Of the rows with at least ``min_words`` words, ``percent`` of a hundred are drawn.
    """
    told = weights(raw, target, ngrams, buckets, id_col, text_col)
    scored = materialize(told.withColumn("score", F.col("weight") + gumbel("id", seed)).withColumn("able", F.col("n_words") >= min_words), "resample-scored")
    n = scored.filter("able").agg(F.sum("copies")).first()[0] or 0
    drawn = percent * n // 100
    ranks = _ranked(scored, drawn).withColumnsRenamed({"id": "_id", "d1": "_d1", "d2": "_d2"})
    same = scored["id"].eqNullSafe(ranks["_id"]) & (scored["d1"] == ranks["_d1"]) & (scored["d2"] == ranks["_d2"])
    joined = scored.join(ranks, same, "left")
    run = joined.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_RUN))))
    first, last = F.col("run") * COPIES_RUN, F.least(F.col("copies"), (F.col("run") + 1) * COPIES_RUN) - 1
    copy = run.withColumn("copy", F.explode(F.sequence(first, last)))
    place = F.col("before") + F.col("copy")
    return copy.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(place < drawn, place + 1).alias("rank"))
