"""The registered queries and the SQL that gives the same rows."""
