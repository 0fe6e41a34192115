"""Tables of the engine and the constants of their data."""

from __future__ import annotations

FILES = "volume string, mft_index bigint, parent bigint, name string, size bigint, is_directory boolean"
JOURNAL = "volume string, usn bigint, reason bigint, file_ref bigint, parent_ref bigint, file_attributes bigint, name string"
CHANGES = "volume string, usn bigint, op string, mft_index bigint, parent bigint, name string, is_directory boolean"
REJECTS = "volume string, usn bigint, op string, mft_index bigint, reason string"

#: The root directory's record number; paths end there.
ROOT = 5
#: Record numbers are the low 48 bits of a file reference.
ID_MASK = (1 << 48) - 1
SIZE_MASK = (1 << 63) - 1

#: Fixed values of the public Win32 SDK.
REASON_FILE_CREATE = 0x00000100
REASON_FILE_DELETE = 0x00000200
REASON_RENAME_OLD_NAME = 0x00001000
REASON_RENAME_NEW_NAME = 0x00002000
REASON_CLOSE = 0x80000000
REASON_MASK = REASON_FILE_CREATE | REASON_FILE_DELETE | REASON_RENAME_OLD_NAME | REASON_RENAME_NEW_NAME
FILE_ATTRIBUTE_DIRECTORY = 0x10

#: Renames that may wait for their new name at once; beyond it the oldest is forgotten.
PENDING_RENAMES = 2000
