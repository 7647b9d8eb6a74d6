"""End-to-end jobs put together from operators, sources and sinks."""
