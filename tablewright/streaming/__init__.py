"""Streaming forms of the row-wise operators and of incremental training."""

from .stream import apply_steps, clean_stream, read_stream, train_on_stream

__all__ = ["apply_steps", "clean_stream", "read_stream", "train_on_stream"]
