"""A Spark-native engine for building, curating and querying a bibliographic catalog."""
