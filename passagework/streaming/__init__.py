"""The batch operators behind Structured Streaming sources and sinks."""
