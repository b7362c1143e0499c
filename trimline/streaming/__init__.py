"""Structured Streaming jobs: ingest, continuous buckets, silver upkeep and periodic reports.

Writers inside ``foreachBatch`` put every micro-batch into its own ``batch_id`` partition and
overwrite only that partition, so a replayed batch leaves the table as it was.
"""
