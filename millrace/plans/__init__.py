"""The registered queries and the SQL that states each one's expected result."""
