"""Training-data operators: ten corpus jobs that nothing else in the library imports."""
