"""tessera: a PySpark-native analytics engine for multi-supplier catalogs."""
