"""All registered queries of the library but those of training data."""

from __future__ import annotations

from . import feed_queries, queries, source_queries, text_queries

QUERIES, SQL, channel_feed = queries.QUERIES, queries.SQL, queries.channel_feed
MODULES = (queries, text_queries, feed_queries, source_queries)
