"""quern: a PySpark-native analytics engine for the operational data of an AI assistant."""
