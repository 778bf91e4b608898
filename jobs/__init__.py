"""Runnable jobs over the given tables, each with a command line and a config file."""
