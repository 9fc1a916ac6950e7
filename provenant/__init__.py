"""provenant: PySpark-native analytics whose numbers carry their evidence."""
