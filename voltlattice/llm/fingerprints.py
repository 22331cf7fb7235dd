"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions.

A paragraph (a line of the text) is hashed to a wide vector of 32-bit lanes, and a fingerprint is
the sum of its paragraphs' vectors, every lane modulo 2**32. So it doesn't depend on their order,
and a paragraph is inserted or deleted by adding or subtracting its vector (``add``, ``remove``).

* ``EQUAL`` lanes are drawn from the paragraph's SHA-256: equal multisets of paragraphs have equal
  lanes, others don't but for a chance of 2**-512.
* One lane counts the paragraph's units, its pairs of adjacent words.
* ``LIKE`` lanes count the units whose hash has a given bit. Twice the count less the number of
  units is a sum of random signs, so the cosine of two such vectors estimates the cosine of the
  documents' bags of units, with a standard error of about ``LIKE ** -0.5``.

Cases: a null text is empty; an empty text is one empty paragraph and no unit. Two fingerprints
that are equal have likeness 1, one without units has likeness 0 to any other. Rows with equal ids
follow each other by text. Repeated rows are rows of their own. Null ids come first. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltlattice.llm.blocks import Blocks
from voltlattice.llm.common import text_of

EQUAL = 16
LIKE = 64
_MODULUS = 2**32
#: One unit's sign bits are counted two to a long, 32 bits apart.
_PAIR = (1 << 32) + 1


def _equal_lanes(text: Column) -> Column:
    """The lanes of all paragraphs of a text, as one string of hexadecimal digits."""
    lane = lambda digest: lambda sum_, i: _modulo(sum_ + F.xxhash64(i, digest).bitwiseAND(_MODULUS - 1))
    order = F.sequence(F.lit(0), F.lit(EQUAL - 1))
    digests = F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))
    return _hex(F.aggregate(digests, F.array_repeat(F.lit(0).cast("long"), EQUAL), lambda sums, g: F.zip_with(sums, order, lane(g))))


def _hex(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def vectors(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the fingerprint ``vector`` (array of longs) of each group's text; keys must tell the rows apart."""
    # The lanes of paragraphs are few: they are summed within the row and carried along as a key,
    # so that the aggregation below, which sees every word, stays small enough to be compiled.
    lanes = rows.select(*keys, F.col(text).alias("_text"), _equal_lanes(F.col(text)).alias("_equal"))
    paragraphs = lanes.select(*keys, "_equal", F.explode(F.split("_text", "\n")).alias("_paragraph"))
    words = F.filter(F.split("_paragraph", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    units = paragraphs.select(*keys, "_equal", words.alias("_words")).select(
        *keys, "_equal", F.explode_outer(F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("b"))).alias("_unit"))
    told = units.select(*keys, "_equal", F.when(F.col("_unit").isNotNull(), F.xxhash64("_unit.a", "_unit.b")).alias("_hash"))
    bits = lambda i: F.shiftrightunsigned("_hash", i).bitwiseAND(F.lit(_PAIR))
    sums = told.groupBy(*keys, "_equal").agg(F.count("_hash").alias("_n"), *(F.sum(bits(i)).alias(f"_p{i}") for i in range(LIKE // 2)))
    pairs = [F.coalesce(f"_p{i}", F.lit(0)) for i in range(LIKE // 2)]
    equal = F.transform(F.sequence(F.lit(0), F.lit(EQUAL - 1)), lambda i: F.conv(F.substring(F.col("_equal"), 8 * i + 1, F.lit(8)), 16, 10).cast("long"))
    counts = F.array(F.col("_n"), *(p.bitwiseAND(_MODULUS - 1) for p in pairs), *(F.shiftrightunsigned(p, 32) for p in pairs))
    return sums.select(*keys, F.concat(equal, F.transform(counts, _modulo)).alias("vector"))


def _modulo(x: Column) -> Column:
    return F.pmod(x, F.lit(_MODULUS))


def add(a: Column, b: Column) -> Column:
    """The vector of all paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: _modulo(x + y))


def remove(a: Column, b: Column) -> Column:
    """The vector of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: _modulo(x - y))


def text_form(vector: Column) -> Column:
    """Eight lower-case hexadecimal digits a lane."""
    return _hex(vector)


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two bags of units, from 0 to 1; 1 for equal fingerprints."""
    def signs(v: Column) -> Column:
        return F.transform(F.slice(v, EQUAL + 2, LIKE), lambda x: (2 * x - F.element_at(v, EQUAL + 1)).cast("double"))

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    sa, sb = signs(a), signs(b)
    norm = F.sqrt(total(F.transform(sa, lambda x: x * x)) * total(F.transform(sb, lambda x: x * x)))
    cosine = total(F.zip_with(sa, sb, lambda x, y: x * y)) / F.when(norm > 0, norm)
    return F.when(a == b, 1.0).otherwise(F.least(F.greatest(F.coalesce(cosine, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, halo, id, text): every row in its block of ascending ids, and behind each block the row that follows it.

    After the last row of all comes the first. One row a block is added; texts are shuffled once,
    by whoever groups the blocks.
    """
    blocks = Blocks(docs, id_col)
    rows = docs.select(blocks.column(id_col).alias("block"), F.lit(False).alias("halo"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # One id for each block: no more than there are shuffle partitions.
    firsts = sorted((r["block"], r["id"]) for r in docs.select(blocks.column(id_col).alias("block"), F.col(id_col).alias("id"))
                    .groupBy("block").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("x")).select("block", F.col("x.id").alias("id"))
                    .collect())
    if not firsts:
        return rows
    before = {b: firsts[k - 1][0] for k, (b, _) in enumerate(firsts)}
    known = [i for _, i in firsts if i is not None]
    at_first = F.col(id_col).isin(known) if known else F.lit(False)
    if len(known) < len(firsts):
        at_first = at_first | F.col(id_col).isNull()
    target = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    heads = (docs.filter(at_first).select(blocks.column(id_col).alias("block"), F.struct(F.col(id_col).alias("id"), text_of(text_col).alias("text")).alias("row"))
             .groupBy("block").agg(F.min("row").alias("row"))
             .select(target[F.col("block")].alias("block"), F.lit(True).alias("halo"), F.col("row.id").alias("id"), F.col("row.text").alias("text")))
    return rows.unionByName(heads)


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document's.

    The edited text has the last quarter of the characters, rounded down, replaced by as many of
    the next document's first, or all it has. Columns: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    order = Window.partitionBy("block").orderBy("halo", F.col("id").asc_nulls_first(), "text")
    told = with_next(docs, id_col, text_col).select(
        "block", "halo", "id", "text", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next"),
        F.char_length("text").alias("n"))
    edited = F.expr("concat(substring(text, 1, int(n - n div 4)), substring(coalesce(next, ''), 1, int(n div 4)))")
    told = told.select("block", "row", "halo", "id", "n", "text", edited.alias("edited"))
    own = F.struct(F.lit(0).alias("version"), F.lit("").alias("sha"), F.col("text").alias("text"))
    other = F.struct(F.lit(1).alias("version"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("text"))
    versions = told.select("block", "row", "halo", "id", "n", F.explode(F.when(F.col("halo"), F.array(own)).otherwise(F.array(own, other))).alias("v"))
    keys = ["block", "row", "halo", "id", "n", "version", "sha"]
    summed = vectors(versions.select("block", "row", "halo", "id", "n", "v.version", "v.sha", "v.text"), keys)
    # By row and version, the edited text follows the text, and the next row's text follows that.
    follow = Window.partitionBy("block").orderBy("row", "version")
    lined = summed.withColumns({"edited": F.lead("vector").over(follow), "next": F.lead("vector", 2).over(follow),
                                "edited_sha": F.lead("sha").over(follow)}).filter("version = 0 AND NOT halo")
    return lined.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("edited_sha").alias("edited_sha256"),
        text_form(F.col("vector")).alias("fingerprint"), text_form(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited")).alias("near_edited"), likeness(F.col("vector"), F.col("next")).alias("near_next"))
