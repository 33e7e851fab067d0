"""Operators for preparing training data at corpus scale. Nothing else in captionloom imports this."""
