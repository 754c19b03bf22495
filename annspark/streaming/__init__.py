"""Micro-batch classification of arriving query vectors."""

from annspark.streaming.classify import classify_stream

__all__ = ["classify_stream"]
