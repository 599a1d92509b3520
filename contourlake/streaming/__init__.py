"""The work queue as a stream of events."""
