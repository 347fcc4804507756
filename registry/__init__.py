"""Named queries over the sample tables, each with its SQL counterpart."""
