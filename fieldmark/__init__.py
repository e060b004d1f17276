"""fieldmark: a PySpark-native engine for sports results, odds and wager-ledger analytics."""
