"""turnloom: conversation-corpus analytics expressed as PySpark DataFrame plans."""
