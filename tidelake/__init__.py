"""Snapshot, time-travel and incremental queries over versioned lakehouse tables, planned on the driver and run by Spark."""
