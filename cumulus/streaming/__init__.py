"""The observation-log cleaning applied to a stream of arriving log files.

The reference is batch only; this module adds no operator of its own. It runs
the same typed cleaning (``operators.cleaning.observation_log``) over a
Structured Streaming file source, so daily log drops can be cleaned as they
land, with the checkpoint in the session's shared checkpoint folder.
"""

from cumulus.streaming.ingest import LOG_TEXT_SCHEMA, clean_log_stream, start_log_ingest

__all__ = ["LOG_TEXT_SCHEMA", "clean_log_stream", "start_log_ingest"]
