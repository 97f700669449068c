"""Agent-session analytics as Spark DataFrame functions.

Families: ``sources`` (what is read), ``functions`` (column expressions),
``operators`` (DataFrame in, DataFrame out), ``plans`` (whole jobs put
together from operators), ``streaming`` (the same operators over Structured
Streaming).
"""

from sessionmill.session import build_session, configure

__all__ = ["build_session", "configure"]
