"""Errors of the index operations.

Fixed values: these texts are what users of such an index match on.
"""

from __future__ import annotations

UNIQUE = "Bitmap indexes do not support unique or primary key constraints"
ONE_KEY = "Bitmap indexes currently support a single key column"
ONE_COLUMN = "Bitmap index currently supports single-column indexes"
KEY_TYPE = "Bitmap index currently supports only integer-like types"
KEY_RANGE = "Bitmap index value {} exceeds 32-bit storage bounds"
TABLE_CHANGED = "Transaction conflict: cannot add an index to a table that has been altered or dropped"
NAME_TAKEN = 'Index with name "{}" already exists!'
INFO_MISSING = "Index {} not found"
DUMP_MISSING = "Bitmap index {} not found"
CONSTRAINT = "Constraint violation in Bitmap index"
ROW_TWICE = "Row ids occur more than once among the rows of a bitmap index"
TABLE_MISSING = "Could not find table {}.{} in catalog {}"
INDEX_MISSING = "Could not find bitmap index {} on table {}.{}"


class IndexError_(Exception):
    """An index operation failed; str() gives the kind of error and the text."""

    kind = "Index Error"

    def __init__(self, text: str):
        super().__init__(f"{self.kind}: {text}")
        self.text = text


class NotImplementedIndexError(IndexError_):
    kind = "Not implemented Error"


class OutOfRangeIndexError(IndexError_):
    kind = "Out of Range Error"


class CatalogIndexError(IndexError_):
    kind = "Catalog Error"


class TransactionIndexError(IndexError_):
    kind = "TransactionContext Error"


class BinderIndexError(IndexError_):
    kind = "Binder Error"


class ConstraintIndexError(IndexError_):
    kind = "Constraint Error"


class SerializationIndexError(IndexError_):
    kind = "Serialization Error"
