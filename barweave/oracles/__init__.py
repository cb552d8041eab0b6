"""SQL that checks the registered queries."""
