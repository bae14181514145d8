"""Registered queries and the training plan."""
