"""Log messages: their dialect, and the code places and errors they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the dialects look like.
PYTHON_PLACE = r'File\s+"([^"]+)",\s+line\s+(\d+)'
PYTHON_FUNCTION = PYTHON_PLACE + r",\s+in\s+(\w+)"
PYTHON_COLUMN = r"(?i)(?:at|line)\s+\d+,\s+column\s+(\d+)"
PYTHON_LEVEL = r"-\s+(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+-"
JAVA_FRAME = r"at\s+([\w.]+)\.(\w+)\(([\w.]+\.java):(\d+)\)"
JAVA_LEVEL = r"(\w+)\s+\[[^\]]+\]\s+[\w.]+\s+-"
NODE_FRAME = r"at\s+(\w+)\.(\w+)\s+\(([^:]+):(\d+):(\d+)\)"
NODE_LEVEL = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\s+(\w+)\s+"
FILE = r"([\w/\\]+\.(?:py|java|js|ts|go|rs|cpp|h|hpp|cc|cxx))"
LINE = r"(?:line\s+|:)(\d+)"
CALL = r"\b(_?[a-z][a-z0-9_]*)\s*\("
DEFINED = r"def\s+([a-z][a-z0-9_]*)"
NAME = r"\b([A-Z][a-zA-Z0-9_]*)\b"
LEVELS = "DEBUG INFO WARN WARNING ERROR FATAL".split()
NO_CLASSES = "ERROR INFO WARNING DEBUG CRITICAL FATAL WARN TRACE ALL OFF True False None".split()
ERROR_BEFORE_COLON = r"(\w+Error|\w+Exception):"
ERROR_WORD = r"\b(\w+Error|\w+Exception|\w+Warning)\b"
SKIPPED_FILES = "node_modules __pycache__ .git".split()


def dialect(message: Column) -> Column:
    """python, java, node or generic; null for blank messages."""
    return (
        F.when(message.isNull() | (F.trim(message) == ""), F.lit(None))
        .when(message.rlike(PYTHON_PLACE) | message.rlike(r"(?i)Traceback\s+\(most recent call last\)"), "python")
        .when(message.rlike(JAVA_FRAME), "java").when(message.rlike(NODE_FRAME), "node").otherwise("generic")
    )


def _all(message: Column, pattern: str, group: int = 1) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(message, F.lit(pattern), F.lit(group))))


def _numbers(texts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(texts, lambda x: x.try_cast("int"))))


def _level(message: Column, pattern: str) -> Column:
    found = F.upper(F.regexp_extract(message, pattern, 1))
    return F.when(found.isin(LEVELS), found)


def parse_log(message: Column) -> Column:
    """A struct of dialect, level, files, lines, columns, functions, classes, modules and errors, each once, in order of value."""
    m = F.coalesce(message, F.lit(""))
    kind = dialect(m)
    none = F.array().cast("array<string>")
    python_files = _all(m, PYTHON_PLACE)
    modules = F.filter(python_files, lambda f: f.endswith(".py") & ~f.contains("site-packages"))
    modules = F.array_sort(F.array_distinct(F.transform(modules, lambda f: F.regexp_replace(F.regexp_replace(f, r"[/\\]", "."), r"\.py", ""))))
    module_classes = F.filter(F.transform(modules, lambda x: F.substring_index(x, ".", -1)), lambda x: x.rlike("^[A-Z]"))
    generic_files = F.filter(_all(m, FILE), lambda f: ~F.lower(f).rlike("|".join(s.replace(".", r"\.") for s in SKIPPED_FILES)))
    generic_lines = F.filter(_numbers(_all(m, LINE)), lambda n: n.between(1, 100_000))
    calls = F.filter(F.array_union(_all(m, CALL), _all(m, DEFINED)), lambda f: F.length(f) > 1)

    def by(python, java, node, generic):
        return F.when(kind == "python", python).when(kind == "java", java).when(kind == "node", node).when(kind == "generic", generic)

    def listed(*each):
        return F.coalesce(F.array_sort(F.array_distinct(by(*each))), none)

    no_numbers = F.array().cast("array<int>")
    level = by(F.nullif(F.regexp_extract(m, PYTHON_LEVEL, 1), F.lit("")), _level(m, JAVA_LEVEL), _level(m, NODE_LEVEL), F.lit(None))
    return F.struct(
        kind.alias("dialect"),
        level.alias("level"),
        listed(python_files, _all(m, JAVA_FRAME, 3), _all(m, NODE_FRAME, 3), generic_files).alias("files"),
        F.coalesce(by(_numbers(_all(m, PYTHON_PLACE, 2)), _numbers(_all(m, JAVA_FRAME, 4)), _numbers(_all(m, NODE_FRAME, 4)), generic_lines), no_numbers).alias("lines"),
        F.coalesce(by(_numbers(_all(m, PYTHON_COLUMN)), no_numbers, _numbers(_all(m, NODE_FRAME, 5)), no_numbers), no_numbers).alias("columns"),
        listed(_all(m, PYTHON_FUNCTION, 3), _all(m, JAVA_FRAME, 2), _all(m, NODE_FRAME, 2), calls).alias("functions"),
        listed(module_classes, F.transform(_all(m, JAVA_FRAME), lambda x: F.substring_index(x, ".", -1)), _all(m, NODE_FRAME), F.filter(_all(m, NAME), lambda x: ~x.isin(NO_CLASSES))).alias("classes"),
        listed(modules, _all(m, JAVA_FRAME), none, none).alias("modules"),
        listed(_all(m, ERROR_BEFORE_COLON), none, none, _all(m, ERROR_WORD)).alias("errors"),
    )


# Words of error and of warning messages.
ERROR_WORDS = "error fatal exception panic critical failed failure".split()
WARNING_WORDS = "warn warning deprecated".split()


def severity(message: Column) -> Column:
    """error, warning or null, by words; errors win."""
    low = F.lower(message)
    return F.when(low.rlike("|".join(ERROR_WORDS)), "error").when(low.rlike("|".join(WARNING_WORDS)), "warning")


def marked(message: Column, word: str) -> Column:
    """The message with a word, as it is written, marked."""
    return F.replace(message, F.lit(word), F.lit(f"<mark>{word}</mark>"))
