"""Registered queries (``catalog``) and their SQL oracle (``oracle``)."""
