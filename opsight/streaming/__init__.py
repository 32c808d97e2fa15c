"""The same definitions as incremental queries over a stream."""
