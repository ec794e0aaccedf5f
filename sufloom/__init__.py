"""A Spark-native k-ordered suffix index: suffix arrays, index tables derived from them, and exact-substring queries."""
