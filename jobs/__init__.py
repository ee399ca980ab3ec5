"""Runnable jobs on the library's operators."""
