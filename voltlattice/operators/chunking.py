"""Document chunking as a narrow, shuffle-free projection."""

from pyspark.sql import DataFrame, functions as F

from voltlattice.functions import text as tx

CHUNK_SIZE = 500
CHUNK_OVERLAP = 100


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(chunk_id, source, section_title, text, type) for documents (source, content, type).

    All pieces of one document are numbered inside its own row, so nothing is shuffled.
    """
    def titled(title, pieces):
        stripped = F.filter(F.transform(pieces, tx.strip), lambda p: p != "")
        return F.transform(stripped, lambda p: F.struct(title.alias("section_title"), p.alias("text")))

    def of_section(body):
        pieces = F.when(F.length(body) <= size, F.array(body)).otherwise(tx.windows(body, size, overlap))
        return tx.bind(tx.section_title(body), lambda title: titled(title, pieces))

    bodies = F.filter(F.transform(tx.sections(F.col("content")), tx.strip), lambda b: b != "")
    markdown = F.flatten(F.transform(bodies, of_section))
    fixed = titled(F.lit(None).cast("string"), tx.windows(F.col("content"), size, overlap))
    pieces = F.when(F.col("type") == "markdown_doc", markdown).otherwise(fixed)
    numbered = docs.select("source", "type", F.posexplode(pieces).alias("pos", "piece"))
    number = F.col("pos") + 1
    return numbered.select(
        tx.chunk_id(tx.slugify(F.col("source")), number).alias("chunk_id"),
        "source",
        F.coalesce(F.col("piece.section_title"), F.format_string("Artifact Data Part %d", number)).alias("section_title"),
        F.col("piece.text").alias("text"),
        "type",
    )
