"""The table checks applied to the micro-batches of a stream."""
