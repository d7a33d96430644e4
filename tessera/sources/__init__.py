"""Where triples come from and go to."""
