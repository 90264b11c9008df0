"""Reactrix: social-engagement analytics as declarative Spark plans."""
