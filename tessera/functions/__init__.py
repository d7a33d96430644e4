"""Functions of terms and literals, as columns."""
