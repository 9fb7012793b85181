"""Whole plans: fixtures, the decision cascade, registered queries."""
