"""Column functions: text cleaning, number parsing and spec decoding."""
