"""Text and path predicates, label parts and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that some file systems reserve.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
# Folders that mark a benchmark's rows.
TEST_FOLDERS = ("test", "testing", "test_split")
IMAGE_FORMATS = {"jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "webp": "WEBP"}
# Month names by language.
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
}


def portable_name(name: Column) -> Column:
    """A name that any file system takes: reserved characters become underscores, outer blanks and dots go."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    clean = F.when(clean == "", "unnamed").otherwise(clean)
    return F.when(F.upper(clean).isin(*RESERVED_NAMES), F.concat(F.lit("_"), clean)).otherwise(clean)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")


def is_benchmark_path(dataset: Column, path: Column, benchmark: str) -> Column:
    """Whether a row lies in a test folder of the named benchmark."""
    return (F.lower(dataset) == benchmark.lower()) & F.coalesce(F.lower(F.get(path_parts(path), 0)).isin(*TEST_FOLDERS), F.lit(False))


def unsafe_path(path: Column) -> Column:
    """Absolute, drive-bound or upward paths."""
    return path.rlike(r"^[/\\]|^[A-Za-z]:") | F.exists(path_parts(path), lambda p: p == "..")


def has_marker(path: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(path), m))


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, empty if none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def image_format(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in IMAGE_FORMATS.items() for x in pair])
    return F.try_element_at(known, extension(path))


def first_word(label: Column) -> Column:
    return F.substring_index(label, " ", 1)


def after_first_word(label: Column) -> Column:
    at = F.instr(label, " ")
    return F.when(at > 0, F.substring(label, at + 1, F.length(label))).otherwise(label)


def email_key(email: Column) -> Column:
    return F.lower(F.trim(email))


def long_date(ts: Column, months: tuple[str, ...] = MONTHS["en"]) -> Column:
    """Day, month name, year, hour and minute."""
    month = F.element_at(F.array(*map(F.lit, months)), F.month(ts))
    return F.concat(F.date_format(ts, "dd"), F.lit(" "), month, F.lit(" "), F.date_format(ts, "yyyy, HH:mm"))


def aspect_difference(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    return F.abs(F.log((w1 / h1) / (w2 / h2)))


def geometry_similarity(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    return F.exp(-aspect_difference(w1, h1, w2, h2))


def scan_status(class_index: Column, label: Column, confidence: Column, threshold: float = 60.0, empty_class: int = 4) -> Column:
    """no_leaf for the empty class, uncertain below the threshold, else healthy or diseased by the label."""
    return (
        F.when(class_index == empty_class, "no_leaf")
        .when(confidence < threshold, "uncertain")
        .when(F.contains(F.lower(label), F.lit("healthy")), "healthy")
        .otherwise("diseased")
    )


def is_false(flag: Column) -> Column:
    """True only for an explicit false; null fails."""
    return flag.eqNullSafe(F.lit(False))
