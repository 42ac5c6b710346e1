"""See the package README for what belongs here."""
