"""ledgerloom: a PySpark-native analytics engine for multi-tenant financial ledgers."""
