"""Task validation and the driver's queries with the SQL that checks them."""
