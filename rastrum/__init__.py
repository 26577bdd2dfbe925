"""PySpark-native engine for large georeferenced images and the vector features derived from them."""
