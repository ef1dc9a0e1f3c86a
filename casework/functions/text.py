"""Text normalisation and paragraph packing, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.schemas import CHUNK_BYTES

# fixed values: the code points with the Unicode White_Space property
SPACES = "".join(
    map(chr, (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
)


def trim_space(c: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.trim(c, F.lit(SPACES))


def nullable_string(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(trim_space(c), F.lit(""))


def normalize_document_text(c: Column) -> Column:
    """LF line ends, trimmed lines, no blank lines."""
    unix = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(unix, "\n"), trim_space)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def normalize_match_text(c: Column) -> Column:
    """Lower case with white space collapsed to single blanks, for phrase tests."""
    return trim_space(F.regexp_replace(F.lower(c), r"(?U)\s++", " "))


def equal_fold(c: Column, ascii_text: str) -> Column:
    """Case-insensitive equality with an ASCII text under Unicode simple folding.

    Only ``k`` and ``s`` have a third, non-ASCII member in their folding class.
    """
    return F.lower(F.translate(c, "Kſ", "ks")) == F.lit(ascii_text.lower())


def pack_paragraphs(c: Column, max_bytes: int = CHUNK_BYTES) -> Column:
    """Greedy packing of whole lines into pieces of at most ``max_bytes`` UTF-8 bytes.

    A single line longer than the limit stands alone, uncut. The text is viewed as ISO-8859-1
    so that one character is one byte; a piece is then the longest stretch within the limit that
    ends at a line end, which one regular expression finds in time linear in the text.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    one_byte_chars = F.decode(F.encode(normalize_document_text(c), "UTF-8"), "ISO-8859-1")
    piece = rf"[^\n](?s:.){{0,{max_bytes - 1}}}(?=\n|\z)|[^\n]+"
    pieces = F.regexp_extract_all(one_byte_chars, F.lit(piece), 0)
    return F.transform(pieces, lambda p: F.decode(F.encode(p, "ISO-8859-1"), "UTF-8"))


def chunk_documents(
    docs: DataFrame, key: str = "document_id", text: str = "text", max_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(key, chunk_index, content) rows; a document without text yields none."""
    return docs.select(key, F.posexplode(pack_paragraphs(F.col(text), max_bytes))).toDF(
        key, "chunk_index", "content"
    )
