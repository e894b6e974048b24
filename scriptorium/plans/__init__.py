"""plans of the scriptorium engine."""
