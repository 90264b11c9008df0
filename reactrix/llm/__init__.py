"""Training-data operators: near-duplicates, decontamination, classifiers, secrets, PII, mixing.

Nothing outside this subpackage imports it.
"""
