"""Column expressions on text, labels and row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python calls whitespace; all of them lie below U+3001.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

WORD_PATTERN = r"\p{L}+"


def strip(text: Column) -> Column:
    """Text without leading and trailing Unicode whitespace.

    ``btrim`` with a character set is linear in the text; ``\\s+$`` as a regular
    expression re-scans every inner run of blanks.
    """
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True when nothing is left of a text once it is stripped; stops at the first letter."""
    return ~text.rlike(f"[^{WHITESPACE}]")


def normalize_label(label: Column) -> Column:
    """Label as it is compared: a string, stripped, in lower case."""
    return F.lower(strip(label.cast("string")))


def words(text: Column) -> Column:
    """Lower-case runs of letters, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def hash_key(row_id: Column, salt: object) -> Column:
    """32 hex digits that order rows pseudo-randomly and the same way everywhere.

    Depends on the id and the salt only, never on partitioning or row order.
    """
    return F.md5(F.concat(F.lit(f"{salt}:"), row_id.cast("string")))


def hash_below(row_id: Column, salt: object, share: float) -> Column:
    """True for about ``share`` of all ids; a filter, no shuffle.

    Hex strings of equal length compare like the numbers they spell.
    """
    if not 0.0 < share < 1.0:
        raise ValueError(f"share must lie strictly between 0 and 1, got {share}")
    return hash_key(row_id, salt) < F.lit(format(int(share * 2**32), "08x"))


def content_key(*columns: Column) -> Column:
    """Digest of several nullable strings; length prefixes keep it unambiguous."""
    parts = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
        for c in columns
    ]
    return F.md5(F.concat(*parts))


def strip_provider(model: Column) -> Column:
    """Model id without its ``provider/`` prefix."""
    return F.regexp_replace(model, r"^[^/]*/", "")


def provider(model: Column) -> Column:
    """The ``provider`` of ``provider/model``; null when there is none."""
    return F.when(F.contains(model, F.lit("/")), F.substring_index(model, "/", 1))


def experiment_name(system: Column, project: Column, experiment: Column) -> Column:
    """``/system/project/experiment``."""
    return F.concat(F.lit("/"), F.concat_ws("/", system, project, experiment))
