"""Ready-made queries over the star-schema and text tables, with reference SQL."""
