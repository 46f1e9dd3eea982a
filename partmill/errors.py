"""Errors with messages for users."""


class PartmillError(Exception):
    """Base of the errors below."""


class WebError(PartmillError):
    """A page or feed can't be read."""


class PdfError(PartmillError):
    """A document has no usable text."""


class LLMError(PartmillError):
    """An injected extractor failed."""


class OutputError(PartmillError):
    """A part list or workbook can't be read or written."""
