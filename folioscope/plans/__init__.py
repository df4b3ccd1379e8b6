"""Named queries over the standard tables and the SQL that states the same results."""
