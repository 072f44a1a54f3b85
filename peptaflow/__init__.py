"""peptaflow: a PySpark-native engine for ranking peptide and variant candidates."""
