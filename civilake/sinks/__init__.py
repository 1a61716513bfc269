"""Writers of results that readers see whole or not at all."""
