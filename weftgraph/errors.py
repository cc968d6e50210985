"""The one exception of the library, with a stable code."""

from __future__ import annotations

#: The codes that callers branch on.
CODES = (
    "E_INVALID_ID", "E_UNKNOWN_NODE", "E_INDEX_RANGE", "E_TOO_LARGE", "E_INVALID_WEIGHT", "E_DIRECTED", "E_SELF_LOOP",
    "E_DUPLICATE_EDGE", "E_DUPLICATE_EDGE_ID", "E_DUPLICATE_ID", "E_DUPLICATE_ROLE", "E_UNKNOWN_COLUMN", "E_COLUMN_TYPE",
    "E_COLUMN_LENGTH", "E_COLUMN_ALIGNMENT", "E_COLUMN_EXISTS", "E_COLUMN_IMMUTABLE", "E_NO_DEFAULT", "E_PARTITION",
    "E_INVALID_PERMUTATION", "E_MASK_LENGTH", "E_GPU_INELIGIBLE", "E_INVALID_SNAPSHOT", "E_BAD_SERIALIZATION",
    "E_UNSUPPORTED_VERSION", "E_DETACHED", "E_BUILDER_DISPOSED", "E_UNSUPPORTED", "E_IMPORT", "E_INVALID_ARGUMENT",
    "E_SNAPSHOT", "E_NOT_LOADED", "E_DISPOSED", "E_ABORTED",
)


class GraphError(Exception):
    """Raised on the driver, before a job where that is possible. details: what the code is about."""

    def __init__(self, code: str, message: str, **details):
        if code not in CODES:
            raise ValueError(code)
        super().__init__(f"{code}: {message}")
        self.code, self.details = code, details
