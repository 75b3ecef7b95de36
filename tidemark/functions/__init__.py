"""Small column functions and codecs."""
