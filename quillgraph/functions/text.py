"""Text functions as native column expressions. Null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}]+"


def normalize_ws(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def note_id(path: Column, prefix: str = "wiki/") -> Column:
    """Prefix and .md stripped, slashes turned into dashes."""
    return F.replace(_bare(path, prefix), F.lit("/"), F.lit("-"))


def note_slug(path: Column, prefix: str = "wiki/") -> Column:
    return F.element_at(F.split(_bare(path, prefix), "/"), -1)


def note_dir(path: Column, prefix: str = "wiki/") -> Column:
    """The first folder below the prefix, or an empty string."""
    parts = F.split(_bare(path, prefix), "/")
    return F.when(path.isNull(), None).when(F.size(parts) > 1, parts[0]).otherwise("")


def _bare(path: Column, prefix: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, rf"^\Q{prefix}\E", "") if prefix else path, r"\.md$", "")


def lenient_date(c: Column) -> Column:
    """The first ten characters as a date when they have the form y-m-d, else null."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), head.try_cast("date"))


def strip_links(c: Column) -> Column:
    """[[a/b#c|label]] becomes label, [[a/b#c]] becomes b."""
    c = F.regexp_replace(c, r"\[\[[^\]\n|]*\|\s*([^\]\n]*?)\s*\]\]", "$1")
    return F.regexp_replace(c, r"\[\[(?:[^\]\n|#]*/)?\s*([^\]\n|#/]*?)\s*(?:#[^\]\n]*)?\]\]", "$1")


def inline_tags(c: Column) -> Column:
    """Words after '#' at the start, after white space or after '('."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(?:^|[\s(])#([\p{L}_][\w/-]*)"), F.lit(1))


def query_terms(c: Column) -> Column:
    """Lower-case search words of more than one byte."""
    return F.filter(F.split(F.lower(c), NON_WORD), lambda w: F.octet_length(w) > 1)


def section(c: Column, heading: str) -> Column:
    """The text under '## heading' up to the next '## '; empty where there is none."""
    return F.regexp_extract(c, rf"(?m)^## \Q{heading}\E[ \t\r]*\n([\s\S]*?)(?=^## |\z)", 1)


def bullets(c: Column) -> Column:
    """Top-level '- ' items."""
    return F.transform(F.filter(F.split(c, "\n"), lambda x: x.startswith("- ")), lambda x: F.trim(F.substring(x, 3, 1_000_000_000)))


def slug_from_filename(c: Column) -> Column:
    """Folder, .md and date prefix dropped; anything but letters and digits becomes one dash."""
    s = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.md$", "")
    s = F.regexp_replace(s, r"^\d{4}-\d{2}-\d{2}[-_]?", "")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(F.length(s) < 2, "capture").otherwise(s)


def strip_headings(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?m)^#+\s*", ""))


def strip_marker(c: Column) -> Column:
    """A list item without its '- ' or '1. '."""
    return F.regexp_replace(F.ltrim(c), r"^(?:[-*] |\d+[.)] )", "")


def preview(c: Column, chars: int = 600) -> Column:
    t = F.ltrim(c)
    return F.concat(F.substring(t, 1, chars), F.when(F.length(t) > chars, "…").otherwise(""))


def truncate_bytes(c: Column, cap: int) -> Column:
    """The longest head of at most cap bytes in UTF-8 that ends between two characters."""
    b = F.encode(c, "utf-8")
    whole = lambda n: ~F.coalesce(F.hex(F.substring(b, n + 1, 1)).between("80", "BF"), F.lit(False))
    end = F.lit(max(cap - 3, 0))
    for n in range(max(cap - 2, 0), cap + 1):
        end = F.when(whole(n), n).otherwise(end)
    return F.when(F.octet_length(c) <= cap, c).otherwise(F.decode(F.substring(b, F.lit(1), end), "utf-8"))


def key_fraction(key: Column) -> Column:
    """A number in [0, 1) from the first eight bytes of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def is_valid_split(key: Column, share: float) -> Column:
    return key_fraction(key) < share


def recency(updated: Column, today: Column, days: int = 548) -> Column:
    """1 for today, falling to 0 after ``days``; null dates give 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.datediff(today, updated), F.lit(days)) / F.lit(float(days))))


def yaml_scalar(c: Column) -> Column:
    """Quoted when a plain scalar would be read as something else."""
    plain = c.rlike(r"^[\p{L}_/][\p{L}\p{N} _./()-]*$") & ~F.lower(c).isin("true", "false", "yes", "no", "on", "off", "null", "~") & ~c.rlike(r"\s$")
    inner = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    quoted = F.concat(F.lit('"'), inner, F.lit('"'))
    return F.when(plain, c).otherwise(quoted)
