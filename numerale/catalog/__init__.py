"""Every operator as a query over the driver's tables, and the SQL that checks it."""
