"""End-to-end pipelines, test-table bindings and the query catalogue."""
