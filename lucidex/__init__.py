"""lucidex: agent-readiness analytics for large web-content tables, on Spark."""

__version__ = "0.1.0"
