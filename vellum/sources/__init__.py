"""Sources: containers from files, bytes, SQL and streams."""
