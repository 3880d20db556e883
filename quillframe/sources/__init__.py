"""Reading document collections and tables."""
