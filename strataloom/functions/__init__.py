"""See the package docstring of strataloom for what lives here."""
