"""Tick and order processing: batch forms of the rules and their Structured Streaming forms."""
