"""DataFrame to DataFrame operators. Each takes its key columns, so any table with such columns will do."""
