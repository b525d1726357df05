"""Spark-native analytics for peptide mass spectrometry."""
