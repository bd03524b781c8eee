"""The registered queries of the core and their SQL."""
