"""Per-vehicle state machines for Structured Streaming and their batch twins."""
