"""Story analytics on Spark: documents in, ranked stories out."""
