"""Operators for preparing training data at corpus scale; each module holds one operator and its query."""
