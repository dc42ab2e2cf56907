"""One-way replication of a database's changes to another document store."""
