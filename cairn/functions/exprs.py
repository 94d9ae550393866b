"""Column expressions with the catalog's value semantics (ASCII folding, blanks, paths, JSON lists)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRINGS = "array<string>"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else, unlike ``lower``."""
    return F.translate(c, _UPPER, _LOWER)


def fold(text: str) -> str:
    """The same for a Python string."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def contains_folded(c: Column, needle: str) -> Column:
    """ASCII-insensitive substring; an empty needle matches every value that is not null."""
    return F.instr(ascii_lower(c), F.lit(fold(needle))) > 0 if needle else c.isNotNull()


def blank(c: Column) -> Column:
    """Null, empty, or spaces only (no other white space)."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def json_list(c: Column) -> Column:
    """A JSON array of strings; malformed text and other values are an empty list."""
    return F.coalesce(F.from_json(c, STRINGS), F.array().cast(STRINGS))


def json_field(c: Column, name: str) -> Column:
    return F.get_json_object(c, f"$.{name}")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The basename without its last extension; a leading dot starts no extension."""
    base = basename(path)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; null where there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", ""))


def in_folder(path: Column, folder: str) -> Column:
    """Directly inside the folder, literally and case-sensitively."""
    if not folder:
        return F.lit(False)
    prefix = folder.rstrip("/") + "/"
    return path.startswith(prefix) & ~F.substring(path, len(prefix) + 1, 1 << 30).contains("/")


def like_literal(text: str) -> str:
    """A LIKE pattern part that matches *text* itself (escape character: backslash)."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def human_size(n: Column) -> Column:
    """B, KB, MB or GB with one decimal from KB on, halves to even."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, name in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")):
        out = F.when(n >= unit, F.format_string(f"%.1f {name}", F.bround(n.cast("double") / unit, 1))).otherwise(out)
    return out


def relative_age(seconds: Column) -> Column:
    """Whole minutes, hours or days ago, halves to even; ages below zero are zero."""
    age = F.greatest(seconds, F.lit(0.0))

    def whole(unit: int, name: str) -> Column:
        return F.concat(F.rint(age / unit).cast("bigint").cast("string"), F.lit(f"{name} ago"))

    return F.when(age < 3600, whole(60, "m")).when(age < 86400, whole(3600, "h")).when(age.isNotNull(), whole(86400, "d"))


def iso_mtime(mtime: Column) -> Column:
    """Epoch seconds, truncated, as UTC text (the session's zone is UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor(mtime)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def kind_label(kind: Column) -> Column:
    """A reference is ``ref``, a declared file its role."""
    return F.when(kind == "referenced", "ref").otherwise(F.regexp_replace(kind, "file$", ""))


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by Unicode decomposition."""
    have, want = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(cp).lower()
        base = unicodedata.normalize("NFD", c)
        if len(c) == 1 and len(base) > 1 and base[0].isascii() and c not in have:
            have.append(c)
            want.append(base[0])
    return "".join(have), "".join(want)


ACCENTED, PLAIN = _accents()


#: One character of a token.
LETTER = r"[\p{L}\p{N}]"


def folded(c: Column) -> Column:
    """Lower-cased text without diacritics; null is empty."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(c), F.lit(f"{LETTER}+"), F.lit(0))
