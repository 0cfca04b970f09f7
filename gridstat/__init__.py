"""PySpark-native analytics over large categorical matrices and the tables around them."""
