"""Spark-native security-log analytics, with training-data operators in ``quarrylog.llm``."""

from quarrylog.config import AnalyzerConfig
from quarrylog.diagnostics import get_logger, setup_logging
from quarrylog.exceptions import ConfigurationError, LogAnalyzerError, LogFileError, ParseError, ReportGenerationError
from quarrylog.reporting import write_reports
from quarrylog.service import DETECTORS, AnalysisResult, AnalysisService, DetectorSpec, analyze_file, analyze_lines, detectors_with, find_alerts

__all__ = [
    "DETECTORS", "AnalysisResult", "AnalysisService", "AnalyzerConfig", "ConfigurationError", "DetectorSpec", "LogAnalyzerError", "LogFileError", "ParseError", "ReportGenerationError",
    "analyze_file", "analyze_lines", "detectors_with", "find_alerts", "get_logger", "setup_logging", "write_reports",
]

__version__ = "0.3.0"
