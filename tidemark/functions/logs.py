"""Expressions that read run logs line by line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that decide a line's severity; the first class that matches wins.
SEVERITY_WORDS = (
    ("ok", ("✅", "done", "success", "complete")),
    ("error", ("❌", "failed", "error", "exception", "traceback")),
    ("warn", ("⚠️", "warn", "skip", "no new", "drift")),
    ("info", ("[full", "[incr", "batch", "====", "load")),
)
GENERAL = "· general ·"


def severity(line: Column) -> Column:
    low, label = F.lower(line), F.lit("other")
    for name, words in reversed(SEVERITY_WORDS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        label = F.when(hit, name).otherwise(label)
    return label


def tagged_table(line: Column, known: Column | None = None) -> Column:
    """The ``db.table`` named in a leading ``[db.table] `` tag, else the general group.

    The tag ends at the first ``] ``. With ``known`` (a boolean made from the tag's
    text by the caller) membership decides; without it the tag must look like a name.
    """
    tag = line_tag(line)
    named = known if known is not None else (
        F.contains(tag, F.lit(".")) & ~F.contains(tag, F.lit("/")) & ~F.contains(tag, F.lit(" "))
    )
    return F.when(tag.isNotNull() & named, tag).otherwise(F.lit(GENERAL))


def line_tag(line: Column) -> Column:
    end = F.instr(line, "] ")
    return F.when(F.startswith(line, F.lit("[")) & (end > 0), F.substr(line, F.lit(2), end - 2))


def line_body(line: Column, table: Column) -> Column:
    return F.when(table != F.lit(GENERAL), F.substr(line, F.instr(line, "] ") + 2)).otherwise(line)


def exported_rows(output: Column) -> Column:
    """Row count from an export tool's output, 0 when it is absent."""
    digits = F.regexp_extract(output, r"Total Rows Exported: +([0-9,]+)", 1)
    return F.coalesce(F.replace(digits, F.lit(",")).try_cast("long"), F.lit(0).cast("long"))
