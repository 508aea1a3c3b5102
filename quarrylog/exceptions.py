"""Errors of the library."""


# Names that callers catch.
class LogAnalyzerError(Exception):
    """Any error of the library."""


class LogFileError(LogAnalyzerError):
    """A log file is missing or is no file."""


class ParseError(LogAnalyzerError):
    """Lines have not the columns that parsing needs."""


class ConfigurationError(LogAnalyzerError):
    """A setting has no usable value."""


class ReportGenerationError(LogAnalyzerError):
    """A report can't be written."""
