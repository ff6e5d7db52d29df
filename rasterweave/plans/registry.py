"""All queries of the raster and frame-stream operators, and their SQL."""

from rasterweave.plans import raster_queries, stream_queries

QUERIES = raster_queries.QUERIES | stream_queries.QUERIES
ORACLES = raster_queries.ORACLES | stream_queries.ORACLES
flagship = raster_queries.flagship
