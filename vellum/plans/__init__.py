"""The operators applied to whole tables, with the same rows in SQL."""
