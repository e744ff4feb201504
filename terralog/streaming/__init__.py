"""Structured Streaming forms.  Operators that are plain aggregates (payload metrics, session state) take a stream as they are."""
