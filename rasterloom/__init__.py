"""A PySpark-native engine for catalogues of gridded data, patches and per-pixel operators."""
