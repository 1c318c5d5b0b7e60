"""A PySpark-native analytics engine: typed frames, expressions, SQL, sources and sinks."""

from .frame import Frame
from .plans.sqlcontext import SQLContext
from .session import build_session

__all__ = ["Frame", "SQLContext", "build_session"]
