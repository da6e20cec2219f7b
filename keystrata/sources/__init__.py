"""Stores, log files and other inputs and outputs."""
