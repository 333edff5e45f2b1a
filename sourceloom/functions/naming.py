"""Names inside type texts, qualified names and import paths."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.rules import BUILTIN_TYPES

# --- fixed values ---
TYPE_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
NAME_WORD = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z0-9]+"
PLAIN_RECEIVER = r"^[A-Za-z_][A-Za-z0-9_]*$"
# --------------------


def words(values) -> Column:
    """Array literal of strings."""
    return F.array(*[F.lit(v) for v in values])


def type_names(type_text: Column) -> Column:
    """Names worth resolving in a type text: `Map<String, List<W>>` -> [Map, List, W].  No name crosses a space."""
    bare = F.replace(F.replace(type_text, F.lit("..."), F.lit("")), F.lit("[]"), F.lit(""))
    found = F.regexp_extract_all(bare, F.lit(TYPE_NAME), F.lit(0))
    return F.filter(found, lambda n: ~n.isin(*BUILTIN_TYPES))


def name_words(qualified_name: Column) -> Column:
    """Distinct lower-case words of a camel-case, dotted name."""
    found = F.regexp_extract_all(qualified_name, F.lit(NAME_WORD), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def import_root(path: Column) -> Column:
    return F.substring_index(path, ".", 2)


def identifier(text: Column, default: str) -> Column:
    """Diagram node id: anything but letters, digits and `_` replaced; never empty."""
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^A-Za-z0-9_]", "_"), F.lit("")), F.lit(default))
