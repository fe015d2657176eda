"""Stable keys and hashes. Missing parts read as empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Column | str


def _text(part: Part) -> Column:
    column = F.col(part) if isinstance(part, str) else part
    return F.coalesce(column.cast("string"), F.lit(""))


def digest(*parts: Part, separator: str = "\0") -> Column:
    """sha-256, in hex, of the parts joined by ``separator``."""
    return F.sha2(F.concat_ws(separator, *map(_text, parts)), 256)


def stable_id(prefix: str, length: int, *parts: Part, separator: str = "\0") -> Column:
    """``prefix`` and the first ``length`` hex digits of the parts' digest."""
    return F.concat(F.lit(prefix), F.substring(digest(*parts, separator=separator), 1, length))


def record_id(dataset: Part, version: Part, role: Part, path: Part) -> Column:
    return stable_id("rec_", 20, dataset, version, role, path)


def composition_id(domain: Part, dataset: Part, source_id: Part, target: Part, sha256: Part) -> Column:
    return stable_id("comp_", 24, domain, dataset, source_id, target, sha256)


def group_id(prefix: str, members: Column, length: int = 20) -> Column:
    """Id of a set of members, whatever their order."""
    return stable_id(prefix, length, F.array_join(F.array_sort(members), "\n"))


def split_group_id(domain: Part, member_id: Part, exact_group: Part, refined_group: Part) -> Column:
    """A refined group comes before an exact one, and that before the record alone."""
    refined, exact = _text(refined_group), _text(exact_group)
    return (
        F.when(refined != "", stable_id("split_group_", 24, domain, F.lit("refined"), refined))
        .when(exact != "", stable_id("split_group_", 24, domain, F.lit("exact"), exact))
        .otherwise(stable_id("split_single_", 24, domain, F.lit("singleton"), member_id))
    )


def seeded(seed: int, *parts: Part) -> Column:
    """A repeatable pseudo-random order key."""
    return digest(F.lit(str(seed)), *parts)


def bits_to_long(bits: Column) -> Column:
    """A 64-character string of 0 and 1 as a signed long."""
    return F.conv(bits, 2, -10).cast("long")


def step_hash(lengths: Column) -> Column:
    """64-bit difference hash of a sequence of 65 numbers or more: bit i is set where the next one is larger; else null.

    The lambda's argument binds the sequence, so it is worked out once a row.
    """

    def of(seq: Column) -> Column:
        bit = lambda i: F.when(F.get(seq, i) > F.get(seq, i - 1), "1").otherwise("0")
        bits = F.transform(F.sequence(F.lit(64), F.lit(1), F.lit(-1)), bit)
        return F.when(F.size(seq) >= 65, bits_to_long(F.array_join(bits, "")))

    return F.get(F.transform(F.array(F.slice(lengths, 1, 65)), of), 0)


def hamming(first: Column, second: Column) -> Column:
    return F.bit_count(first.bitwiseXOR(second))


def canonical_line_ends(text: Column, end: str = "\n") -> Column:
    return F.regexp_replace(text, "\r\n?|\n", end)


def rows_digest(rows: Column) -> Column:
    """Digest of a set of row texts, whatever their order (an aggregate)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(rows)), "\n"), 256)
