"""Registered queries over the shared test tables, and the SQL that checks them."""
