"""Text fragments of cards, prompts and reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: code points that are space within a line, and line breaks ---
_BLANK = [0x09, 0x1F, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_BREAK = [*range(0x0A, 0x0E), 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]
# -------------------------------------------------------------------------------
_SPACE = "".join(map(chr, _BLANK + _BREAK))
_BLANKS, _BREAKS = ("".join(f"\\x{{{p:X}}}" for p in points) for points in (_BLANK, _BREAK))
# start of a line, its leading stars, then text that does not begin with @
_TELLING_LINE = (
    rf"(?:\A|[{_BREAKS}])[{_BLANKS}]*+\**+[{_BLANKS}]*+"
    rf"(?!@)([^{_BLANKS}{_BREAKS}][^{_BREAKS}]*?)[{_BLANKS}]*+(?=[{_BREAKS}]|\z)"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def first_line(doc: Column) -> Column:
    """First line of a doc comment that says something: no markup, no @tag.  NULL if none."""
    body = strip(F.rtrim(F.ltrim(strip(doc), F.lit("/*")), F.lit("*/")))
    return F.nullif(F.regexp_extract(body, _TELLING_LINE, 1), F.lit(""))


def signature(method: Column) -> Column:
    """`mods ret name(type name, ...)`; constructors have no return type."""
    params = F.array_join(
        F.transform(method["parameters"], lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ", "
    )
    head = F.concat(
        method["modifiers"],
        F.when(method["is_constructor"], F.array(method["name"])).otherwise(
            F.array(method["return_type"], method["name"])
        ),
    )
    return F.concat(F.array_join(head, " "), F.lit("("), params, F.lit(")"))


def capped(items: Column, limit: int, total: Column | None = None) -> Column:
    """First `limit` items and, if there are more, how many are not shown."""
    size = F.size(items) if total is None else total
    note = F.format_string("... (%d more not shown)", size - limit)
    return F.when(size <= limit, items).otherwise(F.concat(F.slice(items, 1, limit), F.array(note)))


def truncated_list(items: Column, limit: int, total: Column | None = None) -> Column:
    """`a, b, c, and 4 more`."""
    size = F.size(items) if total is None else total
    shown = F.array_join(F.slice(items, 1, limit), ", ")
    return F.when(size <= limit, shown).otherwise(
        F.concat(shown, F.format_string(", and %d more", size - limit))
    )


def strip_thinking(text: Column) -> Column:
    """Model output without its <think> blocks."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def detail_chars(num_ctx: Column) -> Column:
    """Characters of class detail that fit a context window of `num_ctx` tokens."""
    return F.greatest(F.floor(num_ctx * 0.5), F.lit(500)) * 3
