"""Runnable jobs: each is a function of a session, with a command line around it."""
