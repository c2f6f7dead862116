"""Stateful operators on streams of text pieces and events."""
