"""DataFrame-to-DataFrame operators over the corpus, the registry and the user state."""
