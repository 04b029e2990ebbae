"""Named queries over the driver's tables, each with the SQL that gives its rows."""
