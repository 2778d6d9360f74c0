"""Structured Streaming forms of the feature, rate and escalation operators."""
