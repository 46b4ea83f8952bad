"""Column expressions used across operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanalign.functions.patterns import LANGUAGE_ALIASES, WORD_CHAR

__all__ = [
    "col_of", "is_word_char", "non_blank", "n_bytes", "n_chars", "n_utf16",
    "map_lookup", "normalize_language", "possessive", "preview", "show_newlines",
    "is_continuation_byte", "rule_key", "round6",
]

# Python's str.strip() whitespace set, written out: ASCII controls 9-13 and
# 28-31, U+0085, and every Unicode separator (Zs, Zl, Zp).
_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"
_NOT_SPACE = r"[^\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_word_char(ch) -> Column:
    """True when the (single-character) string is a word character; false
    for null or empty."""
    ch = col_of(ch)
    return F.coalesce(ch.rlike(WORD_CHAR), F.lit(False))


def non_blank(text) -> Column:
    """Not null and holding at least one non-whitespace character."""
    text = col_of(text)
    return text.isNotNull() & text.rlike(_NOT_SPACE)


def n_bytes(text) -> Column:
    return F.octet_length(col_of(text)).cast("bigint")


def n_chars(text) -> Column:
    return F.char_length(col_of(text)).cast("bigint")


def n_utf16(text) -> Column:
    """Length in UTF-16 code units (characters beyond the BMP count 2)."""
    return (F.octet_length(F.encode(col_of(text), "UTF-16LE")) / 2).cast("bigint")


def map_lookup(mapping: dict, key) -> Column:
    """Null-safe dictionary lookup as a literal map (no join)."""
    if not mapping:
        return F.lit(None).cast("string")
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*kv), col_of(key))


def stripped(c) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col_of(c), f"^{_SPACE}+|{_SPACE}+$", "")


def normalize_language(c, aliases: dict | None = None) -> Column:
    """strip + lower + alias lookup; unknown or blank -> null."""
    return map_lookup(aliases if aliases is not None else LANGUAGE_ALIASES, F.lower(stripped(c)))


def possessive(pattern: str) -> str:
    """A pattern of character classes and plain groups with possessive loops,
    for patterns whose loops never have to give anything back: the same
    matches, and the matcher neither recurses nor reads anything twice."""
    return (pattern.replace(")*", ")*+").replace("]*", "]*+").replace("]+", "]++").replace(r"\*+", r"\*++"))


def preview(c, n: int = 50) -> Column:
    return F.left(col_of(c), F.lit(n))


def show_newlines(c) -> Column:
    return F.replace(col_of(c), F.lit("\n"), F.lit("\\n"))


def is_continuation_byte(binary, pos1) -> Column:
    """True when the byte at 1-based position ``pos1`` of ``binary`` is a
    UTF-8 continuation byte (0x80-0xBF), i.e. not a character start."""
    h = F.hex(F.substring(col_of(binary), col_of(pos1), F.lit(1)))
    return (h >= F.lit("80")) & (h <= F.lit("BF"))


def rule_key(type_col="type", s="s", e="e") -> Column:
    return F.concat_ws("_", col_of(type_col), col_of(s).cast("string"), col_of(e).cast("string"))


def round6(c) -> Column:
    return F.round(col_of(c).cast("double"), 6)
