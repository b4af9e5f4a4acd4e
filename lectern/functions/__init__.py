"""Scalar functions over Columns; all of them are built-in expressions unless their name says otherwise."""
