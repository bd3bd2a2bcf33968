"""Spark-native text accentuation: stress marks and ё restoration for Russian text at corpus scale."""
