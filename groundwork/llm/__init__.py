"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.  Modules are imported
one by one, so a Python worker loads only what its own function needs.
"""
