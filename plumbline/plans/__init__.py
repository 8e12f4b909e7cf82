"""Named queries: each runs the library's operators over whole tables and has a SQL twin where SQL can say it."""
