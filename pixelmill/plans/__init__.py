"""Registered queries over the tables, with the SQL that checks them."""
