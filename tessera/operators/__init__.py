"""Graph operators over triples: patterns, closure, induction, rewrites, service and validation."""
