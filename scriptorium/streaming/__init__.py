"""streaming of the scriptorium engine."""
