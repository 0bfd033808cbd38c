"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import as_column

# Sentence ends, separators of questions.
SENTENCE_ENDS = "。！？\n"
SEPARATORS = r"[\s,，。！？?!、；;：:\"'（）()的]+"
NAME_SEPARATORS = r"[\s,，。！？?!、；;：:\"'（）()]+"


def tokens(c: Column | str) -> Column:
    """Estimated tokens: Chinese characters / 1.5 + others / 4, truncated."""
    c = F.coalesce(as_column(c), F.lit(""))
    cjk = F.length(F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}]", ""))
    return (cjk / 1.5 + (F.length(c) - cjk) / 4).cast("int")


def context_tokens(c: Column | str) -> Column:
    return F.floor(F.length(as_column(c)) / 4)


def words(c: Column | str) -> Column:
    """Number of runs of non-blanks."""
    return F.size(F.filter(F.split(F.coalesce(as_column(c), F.lit("")), r"\s+"), lambda x: x != ""))


def lines(c: Column | str) -> Column:
    return F.size(F.split(F.coalesce(as_column(c), F.lit("")), "\n"))


def sentences(c: Column | str) -> Column:
    """Sentences with their end marks; empty ones are left out."""
    return F.filter(F.split(as_column(c), f"(?<=[{SENTENCE_ENDS}])"), lambda x: x != "")


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.split(as_column(c), r"\n\s*\n"), lambda x: F.trim(x) != "")


def chapters(c: Column | str) -> Column:
    return F.split(as_column(c), r"\n(?=第[^\n]*章)")


def keywords(c: Column | str, least: int = 2) -> Column:
    """Tokens of a question with at least *least* characters."""
    return F.filter(F.split(as_column(c), SEPARATORS), lambda x: F.length(x) >= least)


def names(c: Column | str, most: int = 5) -> Column:
    return F.slice(F.filter(F.split(as_column(c), NAME_SEPARATORS), lambda x: F.length(x) > 1), 1, most)


def heading_level(line: Column | str) -> Column:
    """1 to 6 for a markdown heading, else null."""
    mark = F.regexp_extract(as_column(line), r"^(#{1,6})\s+\S", 1)
    return F.when(mark != "", F.length(mark))


def heading_title(line: Column | str) -> Column:
    return F.trim(F.regexp_extract(as_column(line), r"^#{1,6}\s+(.+)$", 1))


def leader_dots(c: Column | str) -> Column:
    """Leader dots of a table of contents become a colon."""
    return F.regexp_replace(F.regexp_replace(as_column(c), r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def page_tag(c: Column | str) -> Column:
    return F.concat(F.lit("<physical_index_"), as_column(c).cast("string"), F.lit(">"))


def page_of_tag(c: Column | str) -> Column:
    """The number in a page tag or after its name, else null."""
    return F.regexp_extract(as_column(c), r"physical_index_(\d+)", 1).try_cast("int")


def start_tags(c: Column | str) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(r"<start_index_(\d+)>"), F.lit(1))


def first_start_tag(c: Column | str) -> Column:
    return F.coalesce(F.get(start_tags(c), F.lit(0)).cast("int"), F.lit(-1))


def last_start_tag(c: Column | str) -> Column:
    return F.coalesce(F.try_element_at(start_tags(c), F.lit(-1)).cast("int"), F.lit(-1))


def without_first_section(c: Column | str) -> Column:
    """The text without its first tagged page."""
    c = as_column(c)
    section = F.regexp_extract(c, r"(?s)<physical_index_\d+>.*?<physical_index_\d+>", 0)
    at = F.instr(c, section)
    return F.when(section == "", c).otherwise(F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + F.length(section))))


def node_number(c: Column | str) -> Column:
    return F.lpad(as_column(c).cast("string"), 8, "0")


def parent_code(c: Column | str) -> Column:
    """``1.2.3`` gives ``1.2``; a code of one part gives null."""
    found = F.regexp_extract(as_column(c), r"^(.*)\.[^.]+$", 1)
    return F.when(found != "", found)


def file_safe(c: Column | str) -> Column:
    return F.replace(as_column(c), F.lit("/"), F.lit("-"))


def page_number(c: Column | str) -> Column:
    return as_column(c).try_cast("int")


def capped(c: Column | str, most: float = 1.0) -> Column:
    return F.least(F.lit(most), as_column(c))


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def fixed_chunks(c: Column | str, size: int) -> Column:
    """Array of (offset, chunk) slices of a text."""
    c = F.coalesce(as_column(c), F.lit(""))
    last = F.greatest(F.floor((F.length(c) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * size).alias("offset"), F.substr(c, i * size + 1, F.lit(size)).alias("chunk")))


def keyword_score(c: Column | str, words: list[str], keep_empty: bool = False) -> Column:
    """Share of the keywords that the text contains, ignoring case.

    An empty keyword is dropped, as it is in every text; *keep_empty* counts it as a match.
    """
    words = [w.lower() for w in words if w or keep_empty]
    if not words:
        return F.lit(0.0)
    text = F.lower(F.coalesce(as_column(c), F.lit("")))
    return sum((F.when(text.contains(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / len(words)
