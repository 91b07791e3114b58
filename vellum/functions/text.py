"""Column functions over text, all of them built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces of a block of with_starts.
BLOCK = 64


def text_lines(text: Column) -> Column:
    """Lines as editors count them: no empty line after a last line feed, none in an empty text, no carriage return at an end."""
    parts = F.split(text, "\n", -1)
    n = F.size(parts)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)
    return F.transform(whole, lambda x: F.regexp_replace(x, "\r$", ""))


def with_starts(rows: DataFrame, pieces: str, name: str, gap: int = 1) -> DataFrame:
    """rows with the array of the characters before each of ``pieces``, ``gap`` characters standing between two.

    Running sums go in two levels, within blocks of pieces and over blocks, as a fold
    over all pieces would copy its array for each of them.
    """
    none = F.array(F.lit(0))
    sums = lambda values, size: F.aggregate(values, none, lambda a, x: F.array_append(a, F.element_at(a, -1) + size(x)))
    at = F.sequence(F.lit(0), F.expr(f"(size({pieces}) - 1) div {BLOCK}").cast("int"))
    blocks = F.transform(at, lambda b: sums(F.slice(F.col(pieces), b * BLOCK + 1, F.lit(BLOCK)), lambda x: F.length(x) + gap))
    out = rows.withColumn("_blocks", blocks).withColumn("_before", sums(F.col("_blocks"), lambda x: F.element_at(x, -1)))
    whole = F.zip_with(F.col("_blocks"), F.slice("_before", F.lit(1), F.size("_blocks")), lambda x, s: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda v: v + s))
    return out.withColumn(name, F.flatten(whole)).drop("_blocks", "_before")


def not_blank(text: Column) -> Column:
    return text.rlike("(?U)\\S")


def first_bytes(text: Column, most: int) -> Column:
    """The characters that lie whole within the first ``most`` bytes."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: F.octet_length(F.left(text, n)) <= most)
    return F.left(text, F.size(fits))


def sanitise(text: Column) -> Column:
    """Tabs become four spaces, carriage returns line feeds; other control characters but line feeds go."""
    spaced = F.translate(F.replace(text, F.lit("\t"), F.lit("    ")), "\r", "\n")
    return F.regexp_replace(spaced, "[\\x00-\\x09\\x0B-\\x1F\\x7F-\\x9F]", "")


def indent(line: Column) -> Column:
    """Number of leading spaces."""
    return F.length(line) - F.length(F.ltrim(line))


def is_block(lines: Column) -> Column:
    """Several lines, of byte lengths within 2 of the first's, and all indented alike."""
    first = F.get(lines, F.lit(0))
    near = F.forall(lines, lambda x: F.abs(F.octet_length(x) - F.octet_length(first)) <= 2)
    alike = F.forall(lines, lambda x: indent(x) == indent(first))
    return (F.size(lines) > 1) & near & alike


def common_indent_removed(lines: Column) -> Column:
    least = F.coalesce(F.array_min(F.transform(lines, indent)), F.lit(0))
    return F.transform(lines, lambda x: F.substring(x, least + 1, F.length(x)))


def strip_first_token(line: Column) -> Column:
    """What follows the first space, if there is one."""
    at = F.instr(line, " ")
    return F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise(line)


def strip_line_number(line: Column) -> Column:
    return F.regexp_replace(line, "^\\s*[0-9]+ ", "")


def numbered(line: Column, row: Column, width: int = 4) -> Column:
    """The line after its right-aligned number, never cut."""
    return F.concat(F.format_string(f"%{width}d ", row), line)


def pad(line: Column, width: Column) -> Column:
    return F.rpad(line, width, F.lit(" "))


def blank_at(line: Column, start: Column, end: Column) -> Column:
    """The line with the columns start to end (from 0, the end exclusive) blank, as far as it goes."""
    n = F.greatest(F.lit(0), F.least(end, F.length(line)) - start)
    return F.when(n > 0, F.concat(F.substring(line, F.lit(1), start), F.repeat(F.lit(" "), n), F.substring(line, start + n + 1, F.length(line)))).otherwise(line)


def put_at(line: Column, start: Column, piece: Column) -> Column:
    """The line with a piece written over it at a column; what goes beyond its end is cut."""
    kept = F.substring(piece, F.lit(1), F.greatest(F.lit(0), F.length(line) - start))
    return F.when(F.length(kept) > 0, F.concat(F.substring(line, F.lit(1), start), kept, F.substring(line, start + F.length(kept) + 1, F.length(line)))).otherwise(line)


def put_growing(line: Column, start: Column, piece: Column) -> Column:
    """As put_at, but the line grows to hold the piece."""
    return F.when(F.length(piece) == 0, line).otherwise(put_at(F.rpad(line, F.greatest(F.length(line), start + F.length(piece)), F.lit(" ")), start, piece))


def dpi_for(columns: Column) -> Column:
    """Resolution for a terminal's width."""
    return F.when(columns.isNull(), 96).when(columns <= 80, 72).when(columns <= 120, 96).when(columns <= 200, 120).otherwise(150)


def z_priority(height: Column, y: Column, max_y: Column) -> Column:
    return F.when((height > 14) & (y < 100), 150).when(height > 14, 125).when(y > max_y - 100, 75).otherwise(100)


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "medium").otherwise("low")


def page_count(info: Column) -> Column:
    """The number on the first line with 'Pages:'."""
    return F.try_to_number(F.regexp_extract(info, "(?m)^[^\n]*Pages:\\s*([0-9]+)", 1), F.lit("9999999999")).cast("long")
