"""scriptorium: a PySpark-native text-forensics and corpus-processing engine."""
