"""functions of the scriptorium engine."""
