"""sources of the scriptorium engine."""
