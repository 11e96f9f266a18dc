"""deskmill: Spark-native processing of support-desk data.

Corpora, search, journals, message streams, guarded exports, reversible
tokens and metadata, all expressed as DataFrame / Structured Streaming jobs.
"""

from deskmill.session import Tables, build_session, workspace

__all__ = ["Tables", "build_session", "workspace"]
