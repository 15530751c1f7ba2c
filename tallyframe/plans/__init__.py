"""Named queries composed from the operators, with their SQL counterparts."""
