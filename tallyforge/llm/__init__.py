"""Operators for preparing large text corpora.

One module per operator; ``queries`` registers them.  Nothing outside this
subpackage imports it.
"""
