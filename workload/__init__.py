"""The registered queries, their SQL counterparts, and the views both read."""
