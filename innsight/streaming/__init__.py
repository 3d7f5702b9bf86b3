"""Streaming.

The reference reads only finished tables in one-shot batch queries: it has
no watermark, window, stateful or late-data operator, so none is built here.
What this package offers is the bulk load (A3) as an incremental,
restartable file ingest: :func:`innsight.streaming.ingest.ingest_files`.
"""
