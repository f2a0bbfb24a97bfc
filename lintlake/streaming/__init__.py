"""Structured Streaming jobs over scan life-cycle events, next to their batch twins."""
