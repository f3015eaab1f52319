"""Every operator bound to the test tables, next to the SQL that must give the same rows."""
