"""Queries over the driver tables: bindings, Spark side and SQL twin."""


def load():
    """(queries, SQL twins) by name."""
    from . import (  # noqa: F401
        detection_queries, document_queries, event_queries, identity_queries, manifest_queries, metric_queries, review_queries,
        segment_queries, stat_queries, stream_queries, version_queries, window_queries,
    )
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
