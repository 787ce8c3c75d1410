"""The two end-to-end flows: ingest and ask."""
