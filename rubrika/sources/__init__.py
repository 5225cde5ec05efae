"""Reading corpora, the prediction log and stored models."""
