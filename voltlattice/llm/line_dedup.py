"""Line dedup by winnowing over line hashes, in DataFrame functions.

A document is the sequence of its lines that hold a word, each trimmed of ASCII white space. A run of
lines with ``min_words`` words or more is deleted where it repeats the same lines at one earlier place,
in an earlier document or earlier in its own. Places are ordered by document id, text and line.

1. Windows: from each line on as many lines as it takes to reach ``min_words`` words, and from each line
   back likewise. The smallest line hash of a window is its fingerprint. Two places that share a
   run of enough words share all windows inside it, so they share fingerprints: that is guaranteed.
2. Positions: fingerprints are joined to their positions, and windows whose fingerprint stands in one
   place only are settled. Of the others, the first place of each window's whole content is found by
   aggregation; windows at later places repeat it.
3. Extension both ways: a repeated run is covered from its first line on by its windows that go forward,
   and back from its last line by those that go back. So the union of repeated windows is all of it,
   whichever earlier place it repeats, and no more.

Only lines that repeat an earlier place are deleted, so a run's first place stays, and so does everything
that is under ``min_words`` words long at any one earlier place. A document is cut into windows as it is
read, without a shuffle. Fingerprints and contents that a third of all windows share are counted per
task before they move, and their joins can be split.

Cases: null and empty texts are left as they are. Rows with the same id and text are one document:
each gets the same result, and they don't repeat each other. Documents with one id and different
texts are ordered by the hash of their text; null ids come first. A document that only repeats
others becomes empty; it is not dropped. A very long text is cut in its own row: a few arrays of one
number a word. Other columns are kept, whatever their names; a numeric ``n_chars`` is brought up to
date. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltlattice.llm.common import fresh, let, materialize, text_of

#: Words a repeated run must have.
MIN_WORDS = 50

_SPACE = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\x0c\r"


def _document(id_col: str, text_col: str) -> Column:
    """Identity of a document: the hash of its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\n"), text_of(text_col))))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(_SPACES))


def _windows(lines: Column, min_words: int) -> Column:
    """Windows of a document's lines (at, line): struct (first, last, at, till, print, place, k1, k2).

    ``first`` and ``last`` count the lines given, ``at`` and ``till`` are their places among all lines;
    ``print`` is the fingerprint, ``place`` its line, and (k1, k2) the hash of the content.
    """
    counts = F.transform(lines, lambda x: F.regexp_count(x["line"], F.lit(rf"[^{_SPACE}]+")))
    # The line of each word, and from it the first word of each line.
    of_word = F.flatten(F.transform(counts, lambda n, k: F.array_repeat(k, n)))

    def starts(of):
        return F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda p: (p == 0) | (F.get(of, p) != F.get(of, p - 1)))

    def found(of, begin, h1, h2):
        words, last = F.size(of), F.size(begin) - 1
        every = F.sequence(F.lit(0), last)
        no = F.lit(None).cast("int")

        def onward(k):
            """The last line of the window from line k on, null if the words don't suffice."""
            return F.when(F.get(begin, k) + min_words <= words, F.get(of, F.get(begin, k) + min_words - 1)).otherwise(no)

        def backward(k):
            """The first line of the window back from line k, null if there is none or it is one that goes onward."""
            end = F.when(k == last, words).otherwise(F.get(begin, k + 1))
            x = F.get(of, end - min_words)
            return F.when(end >= min_words, F.when(onward(x).eqNullSafe(k), no).otherwise(x)).otherwise(no)

        spans = F.concat(F.transform(every, lambda k: F.struct(k.alias("first"), onward(k).alias("last"))),
                         F.transform(every, lambda k: F.struct(backward(k).alias("first"), k.alias("last"))))
        spans = F.filter(spans, lambda w: w["first"].isNotNull() & w["last"].isNotNull())

        def told(w):
            part = F.slice(h1, w["first"] + 1, w["last"] - w["first"] + 1)
            return F.struct(
                w["first"], w["last"], F.get(lines, w["first"])["at"].alias("at"), F.get(lines, w["last"])["at"].alias("till"),
                F.array_min(part).alias("print"), (w["first"] + F.array_position(part, F.array_min(part)) - 1).alias("place"),
                F.xxhash64(part).alias("k1"), F.xxhash64(F.slice(h2, w["first"] + 1, w["last"] - w["first"] + 1)).alias("k2"))

        return F.transform(spans, told)

    h1 = F.transform(lines, lambda x: F.xxhash64(x["line"]))
    h2 = F.transform(lines, lambda x: F.xxhash64(F.lit(1), x["line"]))
    return let(of_word, lambda of: let(starts(of), lambda begin: let(h1, lambda a: let(h2, lambda b: found(of, begin, a, b)))))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, doc, first, last, at, till, print, place, k1, k2): the windows of all documents."""
    rows = docs.select(F.col(id_col).alias("id"), _document(id_col, text_col).alias("doc"), text_of(text_col).alias("text"))
    numbered = F.transform(F.split("text", "\n"), lambda x, k: F.struct(k.alias("at"), _trimmed(x).alias("line")))
    lines = F.filter(numbered, lambda x: x["line"] != "")
    made = let(lines, lambda x: F.when(F.size(x) > 0, _windows(x, min_words)))
    return rows.select("id", "doc", F.inline(made))


def _crowded(rows: DataFrame) -> DataFrame:
    """The windows whose fingerprint stands in more than one place."""
    here = F.struct("doc", "place")
    prints = rows.groupBy("print").agg(F.min(here).alias("low"), F.max(here).alias("high")).filter("low < high")
    return rows.join(prints.select("print"), "print", "left_semi")


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, spans): for each document with deleted lines, the spans (at, till) of places among all its lines, apart from each other."""
    rows = materialize(windows(docs, id_col, text_col, min_words), "line-windows")
    crowded = materialize(_crowded(rows).select("id", "doc", "first", "at", "till", "k1", "k2"), "line-repeats")
    here = F.struct("id", "doc", "first")
    firsts = crowded.groupBy("k1", "k2").agg(F.min(here).alias("earliest"), F.max(here).alias("latest")).filter("earliest < latest")
    later = crowded.join(firsts.drop("latest"), ["k1", "k2"]).filter(here > F.col("earliest")).select("doc", "at", "till").distinct()
    # Spans that overlap or touch are one, so that a document has few however long it is.
    order = Window.partitionBy("doc").orderBy("at", "till")
    reached = F.max("till").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", (F.coalesce(reached + 1 < F.col("at"), F.lit(True))).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(order)).groupBy("doc", "island").agg(F.min("at").alias("at"), F.max("till").alias("till"))
    return islands.groupBy("doc").agg(F.collect_list(F.struct("at", "till")).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later repeated runs of lines deleted from the texts."""
    key, places = fresh(docs, "_document"), fresh(docs, "_places")
    gone = deletions(docs, id_col, text_col, min_words).select(F.col("doc").alias(key), F.col("spans").alias(places))
    # Blank lines are no part of a run and stay.
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.exists(F.col(places), lambda s: i.between(s["at"], s["till"])) | (_trimmed(x) == ""))
    changed = docs.withColumn(key, _document(id_col, text_col)).join(gone, key, "left")
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == "n_chars" and docs.schema[c].dataType.typeName() in ("integer", "long"):
            out.append(F.when(F.col(places).isNull(), F.col(c)).otherwise(F.char_length(text).cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return changed.select(out)
