"""Column expressions: paths, names, confidence, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {
    "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
    "zig": "zig",
}
#: Directories that are not scanned, always and unless libraries are asked for.
NEVER_SCANNED = [".git"]
LIBRARY_DIRS = ["target", "node_modules", ".venv", "vendor", "build", "dist"]
#: How a call was resolved, and how sure that is.
RESOLUTIONS = [("name_only", 30), ("same_file", 60), ("namespace", 80), ("package", 80), ("receiver_type", 90), ("exact", 100)]


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for language in dict.fromkeys(LANGUAGES.values()):
        out = F.when(ext.isin([e for e, x in LANGUAGES.items() if x == language]), F.lit(language)).otherwise(out)
    return out


def is_test_path(path: Column) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.endswith(path, F.lit("_test.go")) | F.array_contains(F.split(path, "/"), "tests") | F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit("/src/test/"))


def is_skipped(path: Column, include_library: bool = False) -> Column:
    """Whether a directory on the way to the file is left out of a scan."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)

    def skipped(d: Column) -> Column:
        hidden = F.startswith(d, F.lit("."))
        if include_library:
            return d.isin(NEVER_SCANNED) | (hidden & (d != ".venv"))
        return d.isin(NEVER_SCANNED + LIBRARY_DIRS) | hidden

    return F.exists(dirs, skipped)


def confidence(kind: Column) -> Column:
    out = F.lit(30)
    for k, (_, c) in enumerate(RESOLUTIONS):
        out = F.when(kind == k, c).otherwise(out)
    return out


def resolution_label(kind: Column) -> Column:
    out = F.lit("unknown")
    for k, (label, _) in enumerate(RESOLUTIONS):
        out = F.when(kind == k, label).otherwise(out)
    return out


def simple_name(callee: Column) -> Column:
    """What follows the last ``::``."""
    return F.element_at(F.split(callee, "::"), -1)


def callee_scope(callee: Column) -> Column:
    """The part before the last ``::``; null without one."""
    parts = F.split(callee, "::")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "::"))


def callee_namespace(callee: Column) -> Column:
    """The segment before the last ``::``; null without one."""
    parts = F.split(callee, "::")
    return F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))


owner_of = callee_scope


def display_name(qualified: Column, name: Column) -> Column:
    return F.coalesce(qualified, name)


def resolution_suffix(label: Column, conf: Column) -> Column:
    return F.when(label.isNotNull() & conf.isNotNull(), F.format_string(" [%s, confidence %d]", label, conf)).otherwise("")


def text_line() -> Column:
    return F.format_string("- %s (%s) - %s:%d", display_name(F.col("qualified_name"), F.col("name")), F.col("kind"), F.col("file_path"), F.col("start_line"))


def combine_paths(prefix: Column, path: Column) -> Column:
    """One slash between, one in front, none behind; a slash alone for nothing."""
    both = F.concat_ws("/", F.when(F.trim(prefix, F.lit("/")) != "", F.trim(prefix, F.lit("/"))), F.when(F.trim(path, F.lit("/")) != "", F.trim(path, F.lit("/"))))
    return F.concat(F.lit("/"), both)


def hint_pattern(hint: Column) -> Column:
    """A pattern for the paths that an import hint names: a dot stands for any separator, a slash for either slash."""
    safe = F.regexp_replace(F.replace(hint, F.lit("\\"), F.lit("/")), r"[^\p{L}\p{N}_./]", r"\\$0")
    safe = F.replace(F.replace(safe, F.lit("."), F.lit("\1")), F.lit("/"), F.lit(r"[/\\]"))
    return F.replace(safe, F.lit("\1"), F.lit(r"[./\\]"))


def path_matches_hint(path: Column, hint: Column) -> Column:
    return (hint == "") | F.rlike(path, hint_pattern(hint))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(c: Column) -> Column:
    """ASCII letters in lower case; others stay as they are."""
    return F.translate(c, UPPER, LOWER)


def fold(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def like_pattern(q: str) -> str:
    """For LIKE on ``folded`` columns: ``%`` and ``_`` of the query stay wildcards, a backslash is itself."""
    return "%" + fold(q).replace("\\", "\\\\") + "%"


def shortened(path: Column, keep: int) -> Column:
    """The path's last characters behind an ellipsis, if it is longer."""
    return F.when(F.length(path) > keep + 3, F.concat(F.lit("..."), F.right(path, F.lit(keep)))).otherwise(path)


def freshness(indexed: Column, head: Column, indexed_status: Column, live_status: Column) -> Column:
    known = head.isNotNull() & live_status.isNotNull() & indexed.isNotNull() & ~indexed.isin("", "N/A")
    fresh = (indexed == head) & (indexed_status == "clean") & (live_status == "clean")
    return F.when(~F.coalesce(known, F.lit(False)), "unknown").when(F.coalesce(fresh, F.lit(False)), "fresh").otherwise("stale")
