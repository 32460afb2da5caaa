"""Composite workflows built from operators as one lazy plan."""

from .workflows import aggregate_workflow, merge_workflow

__all__ = ["aggregate_workflow", "merge_workflow"]
