"""The text kernel: matching, validation and transformation of one text. No Spark here."""
