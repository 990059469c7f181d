"""Intentionally empty: every operator of this engine is a batch operator.

Inputs are complete export files; there is no event-time, watermark or
incremental state to keep, so no streaming operator is provided.
"""
