"""Parsers of layout formats held in string columns, and file listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_ATTRIBUTE = r"""(?s)([^\s=/<>"']++)\s*+=\s*+("[^"]*+"|'[^']*+')"""
_FIELDS = ("CONTENT", "HPOS", "VPOS", "WIDTH", "HEIGHT")


def _field(name: str) -> str:
    """An attribute in quotes of either kind, where it comes first; of a number that no reader of numbers takes, nothing is kept."""
    kept = lambda q: f"[^{q}]*+" if name == "CONTENT" else f"[0-9.eE+-]*+(?={q})|[+-]?(?i:inf|infinity|nan)(?={q})|"
    value = lambda group, q: f"{q}(?<{group}{name}>{kept(q)})[^{q}]*+{q}"
    return rf"{name}(?<m{name}>(?!\k<m{name}>))\s*+=\s*+(?:{value('d', '"')}|{value('s', "'")})"


#: One event of a reader, with all that it passes over before: comments, character data, instructions and other tags, whole. It matches wherever it begins, to the end of a text.
#: Groups that a possessive loop set stay so when what follows fails: they count beside ``tag`` only. A tag with quoted text that isn't an attribute's is ``odd`` and kept as it is.
_EVENT = (
    r"(?s)(?:[^<]++|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?!/?+Page|String))*+"
    r"(?:<(?<tag>S)tring(?=[\s/>])(?:" + "|".join(map(_field, _FIELDS)) + r"""|[^\s=/<>"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'))?+|[\s=/<]++)*+>"""
    r"""|<(?<odd>String(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?<end>/)Page\s*+>|<(?<page>P)age(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<|\z)"""
)
#: XML has no characters of these numbers: one begins an event, one each of its fields.
_SHOWN = "\x02<end><page><tag><odd>" + "".join(f"\x01<d{n}><s{n}>" for n in _FIELDS)
for _number, _group in enumerate(re.findall(r"\(\?<(\w+)>", _EVENT), 1):  # by number, as names are looked up at each match
    _SHOWN = _SHOWN.replace(f"<{_group}>", f"${_number}")


def alto_strings(xml: Column) -> Column:
    """The String tags of a document that stand inside a page, in order, as their fields.

    As a reader of events sees them: a page is entered by its tag, nested or empty as it may be,
    and left at the next end tag, or never; what stands in comments or character data is no tag.
    """
    events = F.regexp_replace(xml, F.lit(_EVENT), F.lit(_SHOWN))
    entered = F.transform(F.split(events, "\x02/", -1), lambda part: F.when(part.contains("\x02P"), F.substring(part, F.instr(part, "\x02P"), F.length(part))).otherwise(""))
    tags = F.filter(F.split(F.array_join(entered, ""), "\x02", -1), lambda t: t.startswith("S"))
    named = lambda t: F.concat(F.lit("<String "), F.array_join(F.regexp_extract_all(F.substring_index(t, "\x01", 1), F.lit(_ATTRIBUTE), F.lit(0)), " "), F.lit(">"))
    return F.transform(tags, lambda t: F.when(t.startswith("String"), F.ltrim(F.regexp_replace(named(t), F.lit(_EVENT), F.lit(_SHOWN)), F.lit("\x02"))).otherwise(t))


def alto_elements(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """(doc_id, ord, content, hpos, vpos, width, height) of the String elements inside pages; entities stay as they are.

    Attributes stand in quotes of either kind, in any order; of one that comes twice the first counts. Numbers that
    can't be read are 0; elements without content go, others keep their number.
    """
    tags = docs.select("doc_id", F.posexplode(alto_strings(F.col(xml))).alias("ord", "tag"))
    fields = tags.where(~F.col("tag").startswith("S\x01\x01")).select("doc_id", "ord", F.split("tag", "\x01", -1).alias("f"))
    number = lambda i: F.coalesce(F.col("f")[i].try_cast("double"), F.lit(0.0)).alias(_FIELDS[i - 1].lower())
    return fields.select("doc_id", "ord", F.col("f")[1].alias("content"), *[number(i) for i in range(2, 6)])


def structured_text_cells(docs: DataFrame, text: str = "text", width: int = 200, height: int = 100) -> DataFrame:
    """(doc_id, row_idx, col_idx, ch): cells of line-oriented structured text; the last writer of a cell wins.

    A line with <char gives the character after its first > at the column of its x,
    four bytes after x=", over 7 points; other lines with </line> end a row.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    is_char = F.col("line").contains("<char")
    ends = F.when(~is_char & F.col("line").contains("</line>"), 1).otherwise(0)
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = F.regexp_replace(F.regexp_extract("line", 'x="(.{4})', 1), '"+$', "").try_cast("double")
    rows = lines.withColumn("row_idx", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("int")).where(is_char)
    ch = F.substring(F.col("line"), F.instr("line", ">") + 1, F.lit(1))
    cells = rows.select("doc_id", "i", "row_idx", F.floor(x / 7).cast("int").alias("col_idx"), ch.alias("ch")).where(F.col("ch") != "")
    cells = cells.where(F.col("col_idx").between(0, width - 1) & (F.col("row_idx") < height))
    return cells.groupBy("doc_id", "row_idx", "col_idx").agg(F.max_by("ch", "i").alias("ch"))


def lines_with_numbers(lines: DataFrame, column: str = "text") -> DataFrame:
    """Lines whose first character that isn't blank is a digit."""
    return lines.where(F.col(column).rlike("^\\s*[0-9]"))


def pdf_paths(files: DataFrame) -> DataFrame:
    """(rank, folder, name, path, size) of the files of ``text_files.read_files`` that end in exactly .pdf, in order."""
    return files.where(F.col("is_file") & F.col("name").rlike("(?s)^.+\\.pdf$")).select("rank", "folder", "name", "path", "size").orderBy("rank", "name", "path")


def first_pdf(files: DataFrame) -> DataFrame:
    """(rank, folder, name, path, size): the first one of the first folder that has one."""
    return pdf_paths(files).limit(1)


def rejection(exists: Column, is_file: Column, path: Column) -> Column:
    """Why a file can't be opened, null if it can.  An extension follows a dot that isn't its name's first character."""
    name = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    return F.when(~exists, "not found").when(~is_file, "not a file").when(~name.rlike("(?s)^.+\\.pdf$"), "not a pdf")
