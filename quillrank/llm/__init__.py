"""Training-data operators: ten corpus operators that work on whole texts. Nothing else in the library imports this."""
