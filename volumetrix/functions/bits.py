"""Bit-level columns: references, packed sizes, reason words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FILE_ATTRIBUTE_DIRECTORY, ID_MASK, REASON_FILE_CREATE, REASON_FILE_DELETE, REASON_RENAME_NEW_NAME, REASON_RENAME_OLD_NAME, SIZE_MASK


def record_number(reference: Column) -> Column:
    """Low 48 bits; the sequence number above them is ignored."""
    return reference.bitwiseAND(F.lit(ID_MASK))


def pack_size(size: Column, is_directory: Column) -> Column:
    """Size in 63 bits and the directory flag in the sign."""
    return F.when(is_directory, size.bitwiseOR(F.lit(-(1 << 63)))).otherwise(size)


def unpack_size(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(SIZE_MASK))


def unpack_is_directory(packed: Column) -> Column:
    return packed < 0


def sign_extend(value: Column, n_bytes: Column) -> Column:
    """Read the low ``n_bytes`` bytes as a signed number; no bytes read as zero."""
    unused = 64 - n_bytes * 8
    return F.when(n_bytes <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.call_function("shiftleft", value, unused.cast("int")), unused.cast("int")))


def has(reason: Column, bits: int) -> Column:
    return reason.bitwiseAND(F.lit(bits)) != 0


def classify_reason(reason: Column) -> Column:
    """old, create, delete, rename or null, in this precedence.

    An old name only queues. A create must have no other bit than CREATE (no bit at all passes too).
    """
    return (
        F.when(has(reason, REASON_RENAME_OLD_NAME), "old")
        .when(reason.bitwiseAND(F.lit(REASON_FILE_CREATE)) == reason, "create")
        .when(has(reason, REASON_FILE_DELETE), "delete")
        .when(has(reason, REASON_RENAME_NEW_NAME), "rename")
    )


def is_directory(attributes: Column) -> Column:
    return has(attributes, FILE_ATTRIBUTE_DIRECTORY)


def components(search: Column) -> Column:
    """Non-empty path components, last first."""
    return F.reverse(F.filter(F.split(search, r"[\\/]"), lambda x: x != ""))
