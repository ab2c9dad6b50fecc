"""Errors, each with a fixed display prefix."""


class LoomError(Exception):
    """Base of all errors raised here; shows its prefix before the message."""

    prefix = "Error"

    def __str__(self) -> str:
        return f"{self.prefix}: {super().__str__()}"


class EmbeddingError(LoomError):
    prefix = "Embedding API error"


class HttpError(LoomError):
    prefix = "HTTP request failed"


class JsonError(LoomError):
    prefix = "JSON serialization/deserialization error"


class SourceIOError(LoomError):
    prefix = "IO error"


class VectorStoreError(LoomError):
    prefix = "Vector store error"


class DocumentNotFound(LoomError):
    prefix = "Document not found"


class InvalidConfig(LoomError):
    prefix = "Invalid configuration"
