"""opsdelta: operations analytics on Spark tables and streams.

Telemetry ingestion, sample statistics, before/after regression verdicts,
snapshot diffs, change/effect correlation, incidents, dependency graphs, corpus
scanning and health scores, all expressed as DataFrame work.
"""
