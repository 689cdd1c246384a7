"""Column, join, window and ranking helpers shared by the operators."""
