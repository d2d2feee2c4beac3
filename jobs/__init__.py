"""Runnable jobs: each a function taking a session, a command line and a small config file beside it."""
