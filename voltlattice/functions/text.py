"""Text helpers for chunking and prompts; lengths count code points."""

from pyspark.sql import Column, functions as F

# Every character that counts as white space in Unicode, plus the four separators.
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def slugify(text: Column) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-zA-Z0-9]", "_"), "_+", "_")
    return F.regexp_replace(squeezed, r"\A_|_\z", "")


def chunk_id(slug: Column, number: Column) -> Column:
    return F.format_string("%s_chunk_%03d", slug, number)


def sections(content: Column) -> Column:
    """Split before every line that opens with one to three hashes and a space."""
    return F.split(content, r"(?U)\n(?=#{1,3}\s)")


def section_title(section: Column) -> Column:
    """First line of a stripped section without its hashes, or General."""
    first = F.substring_index(section, "\n", 1)
    title = strip(F.regexp_replace(first, r"\A#+", ""))
    return F.when(section.startswith("#"), title).otherwise(F.lit("General"))


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; a lambda would recompute a plain expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` characters every ``size - overlap``, in linear time.

    The text is cut once into steps; a window is a step plus the head of the next ones.
    """
    step = size - overlap
    if step < 1:
        raise ValueError("overlap must be smaller than the chunk size")
    reach = -(-overlap // step)

    def joined(pieces):
        def window(piece, i):
            tail = [F.coalesce(F.get(pieces, i + 1 + n), F.lit("")) for n in range(reach)]
            return F.substring(F.concat(piece, *tail), 1, size)

        return F.transform(pieces, window)

    return bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), joined)


def l2_normalize(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.when(squares == 0, F.lit(1e-12)).otherwise(F.sqrt(squares))
    return bind(norm, lambda n: F.transform(vector, lambda x: x.cast("double") / n))
