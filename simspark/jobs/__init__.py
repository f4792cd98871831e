"""The stages as jobs over folders, and their command line."""
