"""The modules that register queries: each has ``QUERIES`` and ``SQL``."""

from tessera.plans import analytics, data_quality, files, mining, places, semi_structured, streams

MODULES = (analytics, data_quality, files, mining, places, semi_structured, streams)
