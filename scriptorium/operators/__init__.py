"""operators of the scriptorium engine."""
