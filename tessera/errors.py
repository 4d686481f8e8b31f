"""Errors with the codes a caller sees."""

from __future__ import annotations


class EngineError(Exception):
    code = "INTERNAL_ERROR"

    def __init__(self, message: str, detail: str | None = None) -> None:
        super().__init__(message)
        self.detail = detail


def _kind(name: str, code: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code})


ValidationError = _kind("ValidationError", "VALIDATION_ERROR")
QueryError = _kind("QueryError", "QUERY_ERROR")
UnsupportedFormat = _kind("UnsupportedFormat", "UNSUPPORTED_FORMAT")
CollectionNotFound = _kind("CollectionNotFound", "COLLECTION_NOT_FOUND")
DocumentNotFound = _kind("DocumentNotFound", "DOCUMENT_NOT_FOUND")
RowNotFound = _kind("RowNotFound", "ROW_NOT_FOUND")
SchemaConflict = _kind("SchemaConflict", "SCHEMA_UPDATE_CONFLICT")
FileTooLarge = _kind("FileTooLarge", "FILE_TOO_LARGE")
ParseError = _kind("ParseError", "PARSE_ERROR")
ExtractionError = _kind("ExtractionError", "EXTRACTION_ERROR")
RateLimitExceeded = _kind("RateLimitExceeded", "RATE_LIMIT_EXCEEDED")
AiServiceError = _kind("AiServiceError", "AI_SERVICE_ERROR")
