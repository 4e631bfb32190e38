"""A Spark-native engine for a bi-temporal text memory: ranking, fusion, packing and upkeep as DataFrame plans."""
