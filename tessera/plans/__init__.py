"""Whole plans: parameters, mosaics, cloud filling, and the registered queries."""
