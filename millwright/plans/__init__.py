"""Views over the driver's tables, registered queries and the SQL that gives the same rows."""
